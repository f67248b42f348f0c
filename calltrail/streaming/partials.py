"""Rollups of streams without state: every micro-batch writes its own partial aggregates, reading merges them (K1, K2, K5).

A partial is what one micro-batch adds to a key: counts and sums add up, first and last values merge by minimum and
maximum. Nothing is kept between micro-batches, so neither the number of keys nor the age of a stream costs memory, no
row can be late, and a replayed batch overwrites its own folder. Every ``SNAPSHOT_EVERY`` batches the partials so far are
merged into a snapshot; reading opens the newest whole snapshot and the batches after it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.analytics import daily_stats_of, day_text, is_error, latency_percentiles, sum0
from ..operators.traces import NEWEST, agent_metric_values, has_trace, span_kinds
from ..schema import REQUESTS
from .jobs import SNAPSHOT_EVERY


class Rollup(NamedTuple):
    """Keys of a rollup, the rows that count, and its measures: (aggregate of a batch, how partials merge)."""

    keys: dict[str, Column]
    where: Column
    measures: dict[str, tuple[Column, str]]

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.where).groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(*[c.alias(k) for k, (c, _) in self.measures.items()])

    def merged(self, partials: DataFrame) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return partials.groupBy(*self.keys).agg(*[how[m](k).alias(k) for k, (_, m) in self.measures.items()])


def _cost() -> Column:
    return F.coalesce(F.sum("estimated_cost"), F.lit(0.0))


def conversations() -> Rollup:
    """What :func:`~calltrail.operators.conversations.conversation_rollup` gives, as partials."""
    return Rollup({"id": F.col("conversation_id")}, F.col("conversation_id").isNotNull(), {
        "total_messages": (F.count(F.lit(1)), "sum"), "total_tokens": (sum0("total_tokens"), "sum"), "total_cost": (_cost(), "sum"),
        "first_message_at": (F.min("created_at"), "min"), "last_message_at": (F.max("created_at"), "max")})


def agents() -> Rollup:
    """The aggregates behind agent figures; the earliest spans merge as (time, id, status)."""
    tool, good, top = span_kinds()
    head = F.struct(*NEWEST, "status")
    return Rollup({"trace_id": F.col("trace_id")}, has_trace(), {
        "_root": (F.min(F.when(top, head)), "min"), "_first": (F.min(head), "min"), "_tools": (F.count_if(tool), "sum"),
        "_tools_ok": (F.count_if(tool & good), "sum"), "_spans": (F.count(F.lit(1)), "sum"), "_ok": (F.count_if(good), "sum")})


def latencies() -> Rollup:
    """Per day, model, outcome and latency: a histogram that gives percentiles and averages of any days without the log."""
    return Rollup({"date": day_text(), "model": F.col("model"), "latency_ms": F.col("latency_ms"), "failed": is_error(), "ranked": F.col("status") != "error"}, F.lit(True), {
        "n": (F.count(F.lit(1)), "sum"), "total_tokens": (sum0("total_tokens"), "sum"), "total_prompt_tokens": (sum0("prompt_tokens"), "sum"),
        "total_completion_tokens": (sum0("completion_tokens"), "sum"), "total_cost": (_cost(), "sum")})


def _numbers(spark: SparkSession, sink: str, kind: str) -> list[int]:
    """Numbers N of the folders ``<kind>=N`` that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    found = [int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}=(\d+)", n))]
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{kind}={n}/_SUCCESS"))
    return sorted(n for n in found if kind == "batch" or done(n))


def current(spark: SparkSession, sink: str, rollup: Rollup, below: int | None = None) -> DataFrame:
    """The rollup as of now (or of the snapshots below a batch, for the next snapshot): one row per key."""
    snapshots = [n for n in _numbers(spark, sink, "snapshot") if below is None or n < below]
    start = snapshots[-1] if snapshots else -1
    folders = [f"{sink}/batch={n}" for n in _numbers(spark, sink, "batch") if n > start and (below is None or n <= below)]
    folders += [f"{sink}/snapshot={start}"] if snapshots else []
    empty = rollup.partial(spark.createDataFrame([], REQUESTS))
    return rollup.merged(spark.read.schema(empty.schema).parquet(*folders) if folders else empty)


def stream_rollup(requests: DataFrame, rollup: Rollup, sink: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataStreamWriter:
    """Keep ``rollup`` of a request stream under ``sink``; :func:`current` reads it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rollup.partial(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id and batch_id % snapshot_every == 0:
            # A replay reads what it read before: the snapshot of an earlier batch and the batches up to this one.
            current(batch.sparkSession, sink, rollup, below=batch_id).write.mode("overwrite").parquet(f"{sink}/snapshot={batch_id}")

    return requests.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def current_agent_metrics(spark: SparkSession, sink: str) -> DataFrame:
    return current(spark, sink, agents()).select(*agent_metric_values())


def _days(histogram: DataFrame, first: str | None, last: str | None) -> DataFrame:
    rows = histogram if first is None else histogram.filter(F.col("date") >= first)
    return rows if last is None else rows.filter(F.col("date") <= last)


def latency_stats_of(histogram: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Nearest-rank percentiles per day from a kept histogram, as ``latency_stats`` gives them from the log."""
    rows = _days(histogram, first, last).filter(F.col("ranked") & F.col("latency_ms").isNotNull())
    return latency_percentiles(rows.groupBy("date", "latency_ms").agg(F.sum("n").alias("n")))


def daily_stats_from(histogram: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rollup per (date, model) from a kept histogram, as ``daily_stats`` gives it from the log, average latency included."""
    return daily_stats_of(_days(histogram, first, last))
