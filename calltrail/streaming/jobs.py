"""Continuously maintained results (K1, K2, K4 to K6).

Changing aggregates are written as versions: every micro-batch writes the rows
it changed under ``batch=<id>`` and overwrites that folder when it is replayed,
which makes the sink idempotent. Every ``SNAPSHOT_EVERY`` batches the job also
writes the newest version of every key under ``snapshot=<id>``; :func:`latest`
reads the newest snapshot and the batches after it, so reading does not slow
down with the age of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.messages import message_content
from ..operators.analytics import is_error
from ..operators.conversations import conversation_rollup
from ..operators.evaluation import eval_candidates
from ..operators.traces import agent_metric_columns, agent_metric_values, has_trace
from ..sources.calls import drop_blocked, normalize_calls


SNAPSHOT_EVERY = 50


def _versions(sink: str, keys: list[str], snapshot_every: int = SNAPSHOT_EVERY):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id and batch_id % snapshot_every == 0:
            newest = latest(batch.sparkSession, sink, keys, below=batch_id)
            newest.write.mode("overwrite").parquet(f"{sink}/snapshot={batch_id}")
    return write


def _stored(spark: SparkSession, sink: str, kind: str) -> DataFrame | None:
    """Rows under ``<kind>=N`` folders that are complete, or None."""
    try:
        return spark.read.option("basePath", sink).parquet(f"{sink}/{kind}=*").withColumn(kind, F.col(kind).cast("long"))
    except AnalysisException as absent:
        if absent.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def version_folders(spark: SparkSession, sink: str, below: int | None = None) -> list[str]:
    """The folders that :func:`latest` reads: the newest snapshot (of an earlier batch than ``below``) and later batches."""
    snapshots = _stored(spark, sink, "snapshot")
    limit = F.lit(True) if below is None else F.col("snapshot") < below
    start = None if snapshots is None else snapshots.filter(limit).agg(F.max("snapshot")).first()[0]
    batches = _stored(spark, sink, "batch")
    after = [] if batches is None else [r[0] for r in batches.filter(F.col("batch") > (-1 if start is None else start)).select("batch").distinct().collect()]
    return [f"{sink}/batch={b}" for b in sorted(after)] + ([] if start is None else [f"{sink}/snapshot={start}"])


def latest(spark: SparkSession, sink: str, keys: list[str], below: int | None = None) -> DataFrame:
    """Newest version of every key; reduced by a merging aggregate."""
    folders = version_folders(spark, sink, below)
    parts = [(kind, [f for f in folders if f.rpartition("/")[2].startswith(f"{kind}=")]) for kind in ("batch", "snapshot")]
    read = [spark.read.option("basePath", sink).parquet(*own).withColumn("_version", F.col(kind).cast("long")).drop(kind) for kind, own in parts if own]
    rows = read[0] if len(read) == 1 else read[0].unionByName(read[1])
    values = [c for c in rows.columns if c not in (*keys, "_version")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_version").alias("_v")).select(*keys, "_v.*"))


def compact(spark: SparkSession, sink: str, target: str, keys: list[str]) -> None:
    """Write the newest versions to a fresh folder as its batch 0."""
    latest(spark, sink, keys).write.mode("overwrite").parquet(f"{target}/batch=0")


def _marked(requests: DataFrame, watermark: str | None) -> DataFrame:
    return requests if watermark is None else requests.withWatermark("created_at", watermark)


def stream_conversation_stats(requests: DataFrame, sink: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataStreamWriter:
    """Conversation rollup kept current. A conversation may go on at any time, so its state is kept."""
    return (conversation_rollup(requests).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(_versions(sink, ["id"], snapshot_every)))


def stream_agent_metrics(requests: DataFrame, sink: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataStreamWriter:
    """Agent figures per trace kept current from merging aggregates; no trace is read again."""
    kept = (requests.filter(has_trace()).groupBy("trace_id").agg(*agent_metric_columns()).select(*agent_metric_values()))
    return kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(_versions(sink, ["trace_id"], snapshot_every))


def stream_eval_queue(requests: DataFrame, watermark: str | None = None) -> DataFrame:
    """Requests to be judged, each id once. With a watermark, ids are forgotten after that time."""
    rows = _marked(eval_candidates(requests), watermark).select("id", "model", "created_at", message_content("output_message").alias("response"))
    return rows.dropDuplicates(["id"]) if watermark is None else rows.dropDuplicatesWithinWatermark(["id"])


def stream_buckets(requests: DataFrame, granularity: str = "daily", watermark: str | None = None) -> DataFrame:
    """Per tumbling window and model: requests, tokens, cost and errors.

    With a watermark the windows can be appended once they close and rows later
    than the watermark are lost; without one use update mode.
    """
    width = "1 hour" if granularity == "hourly" else "1 day"
    return (_marked(requests, watermark).groupBy(F.window("created_at", width).alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("total_requests"), F.sum("prompt_tokens").alias("total_prompt_tokens"),
                 F.sum("completion_tokens").alias("total_completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
                 F.sum("estimated_cost").alias("total_cost"), F.count_if(is_error()).alias("error_count"))
            .select(F.col("w.start").alias("bucket"), "model", "total_requests", "total_prompt_tokens",
                    "total_completion_tokens", "total_tokens", "total_cost", "error_count"))


def write_versions(rows: DataFrame, sink: str, checkpoint: str, keys: list[str], snapshot_every: int = SNAPSHOT_EVERY) -> DataStreamWriter:
    return (rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(_versions(sink, keys, snapshot_every)))


def write_append(rows: DataFrame, sink: str, checkpoint: str) -> DataStreamWriter:
    return (rows.writeStream.outputMode("append").format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint))


def stream_ingest(calls: DataFrame, models: DataFrame, sink: str, checkpoint: str, provider: str = "deepinfra", *,
                  banned: str | None = None, log_payloads: bool = True, mask: bool = False,
                  chunks: Callable[[SparkSession], DataFrame] | None = None) -> DataStreamWriter:
    """Arriving call records to request rows, partitioned by day; calls with banned content are left out.

    ``chunks`` reads the stored payload rows (request_id, seq, data) of streamed
    calls; a call record arrives once its stream has ended, so they are there.
    Folders are ``day=…/batch=…``: filters on days open only theirs. Each
    micro-batch replaces its own folders, so replays do not duplicate rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        passed, _ = drop_blocked(batch, banned)
        own = None
        if chunks is not None:
            streamed = passed.filter("stream").select(F.col("id").alias("request_id"))
            own = chunks(batch.sparkSession).join(streamed, "request_id", "left_semi")
        rows = normalize_calls(passed, models, provider, log_payloads=log_payloads, mask=mask, chunks=own)
        (rows.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch_id)}).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(sink))

    return calls.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def run_available(writer: DataStreamWriter) -> None:
    """Process what is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
