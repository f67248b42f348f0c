"""Streaming jobs over the events table, run until all present files are processed.

Each job writes below the shared folder of the session and the registered query
reads the result back; the SQL checks are those of the batch forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import stream_table
from ..streaming import jobs as J
from ..streaming import partials as P
from ..streaming.alerts import alerts
from ..streaming.streamed_calls import stream_ingest_streamed, written_calls
from .registry import CHECKS, END, START, query, stamp, stamp_sql
from .report_queries import CONV_SQL, ERR, published_rollup
from .source_queries import CALLS_SQL
from .trace_queries import AGENT_OUT, AGENT_SQL, ALERT_SQL
from .views import CALLS, PREFIX, models, requests_over, spark_sql, with_log, with_view


def _stream(spark, folder):
    return requests_over(stream_table(spark, f"{folder}/events.parquet"), spark)


def _paths(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/sink", f"{base}/state"


@query("stream_conversation_stats", with_log(CONV_SQL))
def _conversations(spark, folder):
    sink, state = _paths(spark, "conversations")
    J.run_available(J.stream_conversation_stats(_stream(spark, folder), sink, state))
    return published_rollup(J.latest(spark, sink, ["id"]))


@query("stream_agent_metrics", with_log(AGENT_OUT, AGENT_SQL))
def _agents(spark, folder):
    sink, state = _paths(spark, "agents")
    J.run_available(J.stream_agent_metrics(_stream(spark, folder), sink, state))
    return J.latest(spark, sink, ["trace_id"])


@query("stream_alerts", with_log(ALERT_SQL))
def _alerts(spark, folder):
    sink, state = _paths(spark, "alerts")
    J.run_available(J.write_append(alerts(_stream(spark, folder), latency_ms=2000), sink, state))
    return spark.read.parquet(sink).select("id", "model", "status", "latency", "reason", "error_details")


@query("stream_eval_queue", with_log("SELECT id, model, json_extract_string(output_message, '$.content') AS response FROM r WHERE status <> 'error' AND output_message IS NOT NULL"))
def _queue(spark, folder):
    sink, state = _paths(spark, "queue")
    J.run_available(J.write_append(J.stream_eval_queue(_stream(spark, folder)), sink, state))
    return spark.read.parquet(sink).select("id", "model", "response")


def _bucket_sql(unit):
    return with_log(f"""SELECT {stamp_sql(f"date_trunc('{unit}', created_at)")} AS bucket, model, CAST(count(*) AS BIGINT) AS total_requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
      round(sum(estimated_cost), 6) AS total_cost, CAST(sum({ERR}) AS BIGINT) AS error_count FROM r GROUP BY 1, 2""")


def _buckets(spark, folder, granularity):
    sink, state = _paths(spark, "buckets")
    J.run_available(J.write_versions(J.stream_buckets(_stream(spark, folder), granularity), sink, state, ["bucket", "model"]))
    rows = J.latest(spark, sink, ["bucket", "model"])
    return rows.select(stamp("bucket").alias("bucket"), "model", "total_requests", "total_tokens", F.round("total_cost", 6).alias("total_cost"), "error_count")


@query("stream_buckets_daily", _bucket_sql("day"))
def _daily(spark, folder):
    return _buckets(spark, folder, "daily")


@query("stream_buckets_hourly", _bucket_sql("hour"))
def _hourly(spark, folder):
    return _buckets(spark, folder, "hourly")


@query("stream_ingest", with_view(CALLS, """SELECT id, m AS model, CAST(pt + ct AS BIGINT) AS total_tokens, CASE WHEN broken OR event_type = 'error' THEN 'error' ELSE 'success' END AS status
  FROM t WHERE event_type <> 'purchase'""", CALLS_SQL))
def _ingest(spark, folder):
    sink, state = _paths(spark, "ingest")
    stream_table(spark, f"{folder}/events.parquet").createOrReplaceTempView(PREFIX + "arriving_calls")
    raw = spark.sql(spark_sql(CALLS).replace("FROM events e", f"FROM {PREFIX}arriving_calls e"))
    header = F.create_map(F.lit("X-User-Id"), F.col("user_header"))
    calls = raw.select("id", "request", "response", header.alias("headers"), F.col("http_status").cast("int").alias("http_status"), "latency_ms",
                       "transport_error", F.lit(False).alias("stream"), "created_at")
    J.run_available(J.stream_ingest(calls, models(spark), sink, state, banned="purchase"))
    return spark.read.parquet(sink).select("id", "model", "total_tokens", "status")


# Every conversation text as a streamed call and a stream of chunks, some refused; the state holds them until they are whole.
@query("stream_ingest_streamed", """SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, CASE WHEN turn % 5 <> 4 THEN text END AS answer,
  CASE WHEN turn % 5 = 4 THEN CAST(0 AS BIGINT) ELSE 7 END AS prompt_tokens, CASE WHEN turn % 5 = 4 THEN CAST(0 AS BIGINT) ELSE CAST(turn AS BIGINT) END AS completion_tokens,
  CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'success' END AS status FROM conversations""")
def _ingest_streamed(spark, folder):
    sink, state = _paths(spark, "streamed")
    talk = stream_table(spark, f"{folder}/conversations.parquet")
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    calls = talk.select(
        key.alias("id"), F.lit('{"model":"m","messages":[{"role":"user","content":"hi"}]}').alias("request"), F.lit(None).cast("string").alias("response"),
        F.create_map(F.lit("x-user-id"), F.lit("u")).alias("headers"), F.when(F.col("turn") % 5 == 4, 500).otherwise(200).alias("http_status"), F.lit(3).cast("long").alias("latency_ms"),
        F.lit(None).cast("string").alias("transport_error"), F.lit(True).alias("stream"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    delta = lambda w: F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content")).alias("delta"))).alias("choices")))
    usage = F.to_json(F.struct(F.struct(F.lit(7).cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens")).alias("usage")))
    data = F.concat(F.transform(F.split("text", "(?<= )"), delta), F.array(F.lit("{broken"), usage, F.lit("[DONE]")))
    chunks = talk.select(key.alias("request_id"), F.posexplode(data).alias("seq", "data"))
    J.run_available(stream_ingest_streamed(calls, chunks, models(spark), sink, state))
    rows = written_calls(spark, sink)
    return rows.select("id", F.get_json_object("output_message", "$.content").alias("answer"), "prompt_tokens", "completion_tokens", "status")


def _rollup(spark, folder, name, rollup):
    sink, state = _paths(spark, name)
    J.run_available(P.stream_rollup(_stream(spark, folder), rollup, sink, state))
    return sink


@query("stream_conversation_partials", with_log(CONV_SQL))
def _conversation_partials(spark, folder):
    return published_rollup(P.current(spark, _rollup(spark, folder, "conversation-partials", P.conversations()), P.conversations()))


@query("stream_agent_partials", with_log(AGENT_OUT, AGENT_SQL))
def _agent_partials(spark, folder):
    return P.current_agent_metrics(spark, _rollup(spark, folder, "agent-partials", P.agents()))


@query("stream_latency_stats", CHECKS["latency_stats"])
def _latency_partials(spark, folder):
    histogram = P.current(spark, _rollup(spark, folder, "latency-partials", P.latencies()), P.latencies())
    return P.latency_stats_of(histogram, START[:10], END[:10])


@query("stream_daily_stats", CHECKS["daily_stats"])
def _daily_partials(spark, folder):
    return P.daily_stats_from(P.current(spark, _rollup(spark, folder, "daily-partials", P.latencies()), P.latencies())).withColumn("total_cost", F.round("total_cost", 6))
