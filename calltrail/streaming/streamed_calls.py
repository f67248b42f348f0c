"""Streamed calls whose payload chunks arrive before, with or after their call record (A4 and K6 over micro-batches).

Call records and chunks are one keyed stream. What belongs to a call waits in its state until the call is complete: the
record, the end mark and every chunk number up to it. Then record and chunks are released, assembled and written once. A
timer releases what is incomplete when nothing has come for some time, so state is bounded by the calls that are
open. Time is that of arrival (the micro-batch), so nothing is ever late, and a run over what is there comes to an end.
Chunks that wait stay in the state store as a list and are read in batches, whatever their number; a call that comes whole
passes without touching it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.storagelevel import StorageLevel

from ..sources.calls import STREAM_END, drop_blocked, normalize_calls

#: How long an incomplete call waits for more, in milliseconds, and by how much clocks of drivers may differ.
PATIENCE_MS, CLOCK_SLACK = 10 * 60 * 1000, "1 minute"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_RELEASED = "request_id string, call string, seq long, data string"
_ROWS = 5000


def add_ranges(ranges: list[list[int]], numbers: Iterable[int]) -> tuple[list[list[int]], list[int]]:
    """(sorted disjoint ranges with ``numbers`` added, those of the numbers that are new)."""
    starts = [a for a, _ in ranges]

    def held(n: int) -> bool:
        k = bisect_right(starts, n)
        return k > 0 and n <= ranges[k - 1][1]

    fresh = [n for n in sorted(set(numbers)) if not held(n)]
    merged: list[list[int]] = []
    for a, b in sorted([*map(list, ranges), *([n, n] for n in fresh)]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged, fresh


class OpenCalls(StatefulProcessor):
    """Holds a call's record and chunks until it is complete or nothing has come for ``patience_ms``.

    A call that comes whole in one micro-batch goes out as it came: each use of the state is a round trip to the JVM, so
    only what has to wait, or is beyond ``_ROWS`` chunks, is put there.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "call string, ranges string, last long")
        self.chunks = handle.getListState("chunks", "seq long, data string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.progress.get()
        call, ranges, last = (known[0], json.loads(known[1]), known[2]) if known else (None, [], None)
        arrived, stored = 0, known is not None
        held: list[tuple[int, str]] = []
        for batch in rows:
            arrived = max(arrived, int(batch["at"].max()))
            parts: dict[int, str] = {}
            for record, seq, data in zip(batch["call"].tolist(), batch["seq"].tolist(), batch["data"].tolist()):
                if call is None and isinstance(record, str):
                    call = record
                if seq is not None and seq == seq:
                    parts.setdefault(int(seq), data if isinstance(data, str) else None)
            ranges, fresh = add_ranges(ranges, parts)
            held += [(seq, parts[seq]) for seq in fresh]
            last = max((seq for seq in fresh if parts[seq] == STREAM_END), default=last)
            if len(held) > _ROWS:
                self.chunks.appendList(held)
                held, stored = [], True
        whole = call is not None and last is not None and any(a <= 0 and b >= last for a, b in ranges)
        if whole and not stored:
            yield self._frame(key, [(None, None), *held], call)
            return
        if held:
            self.chunks.appendList(held)
        if whole:
            yield from self._release(key, call)
        else:
            self.progress.update((call, json.dumps(ranges), last))
            if known is not None:
                self._stop_timers()
            self.handle.registerTimer(arrived + self.patience_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = self.progress.get()
        if known is not None:
            yield from self._release(key, known[0])

    def _stop_timers(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    def _release(self, key: Any, call: str | None) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str]] = []
        yield self._frame(key, [(None, None)], call)
        if self.chunks.exists():
            for seq, data in self.chunks.get():
                held.append((seq, data))
                if len(held) == _ROWS:
                    yield self._frame(key, held)
                    held = []
        if held:
            yield self._frame(key, held)
        self._stop_timers()
        self.progress.clear()
        self.chunks.clear()

    @staticmethod
    def _frame(key: Any, rows: list[tuple], call: str | None = None) -> pd.DataFrame:
        """Released rows; the record stands in the first."""
        seqs, data = zip(*rows)
        return pd.DataFrame({"request_id": [key[0]] * len(rows), "call": [call, *[None] * (len(rows) - 1)], "seq": seqs, "data": data}, dtype=object)

    def close(self) -> None:
        pass


def released_calls(calls: DataFrame, chunks: DataFrame, patience_ms: int = PATIENCE_MS, clock_slack: str = CLOCK_SLACK) -> DataFrame:
    """Stream of (request_id, call, seq, data): for every released call a row with its record as JSON text, and its chunks.

    Of ``calls`` only streamed ones are held and released; ``chunks`` (request_id, seq, data) are their payload rows, numbered from 0 without gaps.
    A chunk that comes again is left out. Where the record never came, ``call`` is NULL.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    nothing = F.lit(None).cast("string")
    both = (_records(calls, F.coalesce("stream", F.lit(False)).alias("held"))
            .unionByName(chunks.select("request_id", nothing.alias("call"), F.col("seq").cast("long").alias("seq"), "data", F.lit(True).alias("held"))))
    arriving = both.filter("request_id IS NOT NULL").withColumn("at", F.current_timestamp()).withWatermark("at", clock_slack)
    # Records that are not held move time on, too: the mention of time keeps this filter behind the watermark.
    held = arriving.filter(F.col("held") | (F.col("at") < F.lit("1970-01-01").cast("timestamp"))).select("request_id", "call", "seq", "data", F.unix_millis("at").alias("at"))
    return held.groupBy("request_id").transformWithStateInPandas(
        OpenCalls(patience_ms), outputStructType=_RELEASED, outputMode="append", timeMode="eventTime")


def _records(calls: DataFrame, *more: Column) -> DataFrame:
    """(request_id, call, seq, data) of call records, the record as JSON text."""
    return calls.select(F.col("id").alias("request_id"), F.to_json(F.struct(*calls.columns), _MICROS).alias("call"), F.lit(None).cast("long").alias("seq"),
                        F.lit(None).cast("string").alias("data"), *more)


def stream_ingest_streamed(calls: DataFrame, chunks: DataFrame, models: DataFrame, sink: str, checkpoint: str, provider: str = "deepinfra", *,
                           banned: str | None = None, log_payloads: bool = True, mask: bool = False, patience_ms: int = PATIENCE_MS,
                           clock_slack: str = CLOCK_SLACK) -> DataStreamWriter:
    """Arriving call records and payload chunks to request rows under ``<sink>/calls``, partitioned by day and micro-batch.

    Records that are not streamed are written as they come. A streamed one is written once: when it is complete, or with the
    chunks there are when none has come for ``patience_ms``. Chunks whose record never came, or that came after
    their call was released, go to ``<sink>/orphans``. Calls with banned content are left out. Each micro-batch replaces its
    own folders, so replays do not duplicate rows.
    """
    streamed = F.coalesce("stream", F.lit(False))
    rows = released_calls(calls, chunks, patience_ms, clock_slack).unionByName(_records(calls.filter(~streamed)))
    schema = calls.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # the state is not to be read again for each use
        try:
            records = batch.filter("call IS NOT NULL").select(F.from_json("call", schema, _MICROS).alias("c")).select("c.*")
            passed, _ = drop_blocked(records, banned)
            parts = batch.filter("data IS NOT NULL").select("request_id", "seq", "data")
            known = batch.filter("call IS NOT NULL").select("request_id")
            done = normalize_calls(passed, models, provider, log_payloads=log_payloads, mask=mask, chunks=parts.join(known, "request_id", "left_semi"))
            (done.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch_id)}).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{sink}/calls"))
            parts.join(known, "request_id", "left_anti").write.mode("overwrite").parquet(f"{sink}/orphans/batch={batch_id}")
        finally:
            batch.unpersist()

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def written_calls(spark: SparkSession, sink: str) -> DataFrame | None:
    """Request rows that :func:`stream_ingest_streamed` has written so far, None before the first."""
    try:
        return spark.read.parquet(f"{sink}/calls")
    except AnalysisException as absent:
        if absent.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
