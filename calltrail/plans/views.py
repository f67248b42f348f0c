"""Views that give the given tables the shape of a call log.

The text is plain SQL shared by Spark and the checking engine. ``{J}`` stands
for the JSON getter and ``{A}`` for the array constructor, the only spots where
the two dialects differ. ``chr(92)`` is a backslash in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.cost import estimate_cost
from ..sources.tables import load_table

# Model prices per million tokens.
MODELS = """
SELECT * FROM (VALUES
  ('north/pebble-9b', CAST(0.08 AS DOUBLE), CAST(0.16 AS DOUBLE)),
  ('north/boulder-80b', CAST(0.45 AS DOUBLE), CAST(0.75 AS DOUBLE)),
  ('north/boulder-80b-v2', CAST(0.5 AS DOUBLE), CAST(0.95 AS DOUBLE)),
  ('deepseek-ai/DeepSeek-V3', CAST(0.49 AS DOUBLE), CAST(0.89 AS DOUBLE)),
  ('meadow/clover-30b', CAST(0.21 AS DOUBLE), CAST(0.33 AS DOUBLE))
) AS m(id, input_cost_per_million, output_cost_per_million)
"""

MODEL_OF_K = """CASE k % 6 WHEN 0 THEN 'north/pebble-9b'
    WHEN 1 THEN 'north/boulder-80b' WHEN 2 THEN 'north/boulder-80b-v2'
    WHEN 3 THEN 'deepseek-ai/DeepSeek-V3' WHEN 4 THEN 'meadow/clover-30b' ELSE 'unlisted/willow-70b' END"""

EVENTS_K = "(SELECT e.*, CAST({J} AS INT) AS k FROM events e) x"

# Call log: traces of five spans with one orphan parent, an unknown model, rows without user,
# feedback, evaluation and metadata documents, tool spans, playground runs.
REQUESTS = f"""
SELECT 'req_' || CAST(event_id AS STRING) AS id,
  CASE WHEN event_id % 3 = 0 THEN 'conv_' || CAST(user_id AS STRING) || '_' || CAST(event_id % 4 AS STRING) END AS conversation_id,
  {MODEL_OF_K} AS model,
  'deepinfra' AS provider,
  CASE WHEN event_id % 10 IN (4, 8) THEN '[{{"role":"user","content":"Input: q' || CAST(k AS STRING) || chr(92) || 'nOutput: rows ' || CAST(event_id AS STRING) || '"}}]'
    ELSE '[{{"role":"system","content":"s' || CAST(k AS STRING) || '"}},{{"role":"user","content":"' || event_type || ' by user' || CAST(user_id AS STRING) || '@example.com"}}]' END AS input_messages,
  CASE WHEN event_type <> 'error' THEN '{{"role":"assistant","content":"answer ' || CAST(k AS STRING) || '"}}' END AS output_message,
  CAST(30 + 7 * k AS BIGINT) AS prompt_tokens,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 50 + event_id % 250 END AS BIGINT) AS completion_tokens,
  CAST(30 + 7 * k + CASE WHEN event_type = 'error' THEN 0 ELSE 50 + event_id % 250 END AS BIGINT) AS total_tokens,
  CAST(floor(value * 10) AS BIGINT) + 100 AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'awaiting_approval'
    WHEN event_type = 'signup' AND event_id % 10 = 6 THEN 'rejected' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'The key of this project has expired' WHEN 1 THEN 'No worker took the request'
    WHEN 2 THEN 'Quota of the minute is used up (429)' ELSE 'Upstream closed the socket after 30 s' END END AS error_message,
  CASE WHEN k % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS temperature,
  CASE WHEN k % 3 = 0 THEN CAST(512 AS BIGINT) END AS max_tokens,
  CASE WHEN user_id % 10 <> 0 THEN 'user_' || CAST(user_id AS STRING) END AS user_id,
  CASE event_type WHEN 'purchase' THEN '{{"context":"order ' || CAST(k AS STRING) || '","expected_answer":"The answer is ' || CAST(k AS STRING) || '."}}'
    WHEN 'view' THEN '{{"retrieved_ids":[' || CAST(k % 5 AS STRING) || ',' || CAST(k % 7 AS STRING) || ',' || CAST(k % 3 AS STRING) || '],"relevant_ids":[' || CAST(k % 2 AS STRING) || ',4]}}' END AS metadata,
  CASE event_type WHEN 'click' THEN '["playground","chat"]' WHEN 'view' THEN '["prod"]' END AS tags,
  event_id % 2 = 1 AS stream,
  CASE WHEN event_id % 4 = 0 THEN '{{"model":"m","messages":[{{"role":"user","content":"raw ' || CAST(k AS STRING) || '"}}]}}' END AS raw_request,
  CASE WHEN event_id % 4 = 0 THEN '{{"choices":[{{"message":{{"role":"assistant","content":"raw answer ' || CAST(k AS STRING) || '"}}}}]}}' END AS raw_response,
  CASE WHEN event_type <> 'error' AND k % 5 <> 0 THEN '{{"score":' || CASE WHEN k % 5 >= 3 THEN '1' WHEN k % 5 = 1 THEN '-1' ELSE 'null' END
    || ',"rating":' || CAST(1 + k % 5 AS STRING) || ',"task_success":' || CASE WHEN k % 5 >= 3 THEN 'true' ELSE 'false' END || '}}' END AS feedback,
  CASE WHEN event_type <> 'error' AND k % 4 <> 0 THEN '{{"score":' || CAST(1 + k % 4 AS STRING) || '.' || CAST(event_id % 10 AS STRING)
    || CASE WHEN k % 4 = 1 THEN ',"task_type":"code_generation"' WHEN k % 4 = 2 THEN ',"category":"helpfulness"' ELSE '' END
    || CASE WHEN k % 3 = 0 THEN ',"faithfulness":4.' || CAST(event_id % 10 AS STRING) || ',"recall_at_k":0.5,"hallucination_rate":0.1' ELSE '' END
    || CASE WHEN k % 7 = 0 THEN ',"exact_match":' || CAST(event_id % 2 AS STRING) || ',"f1_score":0.75' ELSE '' END
    || CASE WHEN k % 11 = 0 THEN ',"tool_success_rate":0.5,"iteration_count":' || CAST(1 + k % 4 AS STRING) ELSE '' END || '}}'
    WHEN k % 20 = 0 THEN 'not json' END AS evaluation,
  CASE WHEN event_id % 2 = 0 THEN 'trace_' || CAST(CAST(floor(event_id / 10.0) AS BIGINT) AS STRING) END AS trace_id,
  'span_' || CAST(event_id AS STRING) AS span_id,
  CASE event_id % 10 WHEN 2 THEN 'span_' || CAST(event_id - 2 AS STRING) WHEN 4 THEN 'span_' || CAST(event_id - 2 AS STRING)
    WHEN 6 THEN 'span_missing' WHEN 8 THEN 'span_' || CAST(event_id - 4 AS STRING) WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'root' END END AS parent_span_id,
  CASE event_id % 10 WHEN 0 THEN 'Agent run' WHEN 2 THEN 'Classifier' WHEN 4 THEN 'DB tool' WHEN 6 THEN 'Approval' WHEN 8 THEN 'Search tool' END AS span_name,
  CASE event_id % 10 WHEN 0 THEN 'agent' WHEN 2 THEN 'llm' WHEN 4 THEN 'tool' WHEN 6 THEN 'check' WHEN 8 THEN 'tool' END AS span_type,
  ts AS created_at
FROM {EVENTS_K}
"""

# The same log without cost, priced in SQL (the Spark side prices it with the operator).
PRICED = """
SELECT q.*, coalesce(floor(((q.prompt_tokens / CAST(1000000 AS DOUBLE)) * m.input_cost_per_million
  + (q.completion_tokens / CAST(1000000 AS DOUBLE)) * m.output_cost_per_million) * 1000000.0 + 0.5) / CAST(1000000 AS DOUBLE), 0) AS estimated_cost
FROM req q LEFT JOIN models m ON q.model = m.id
"""

# Raw gateway calls, normal and streamed, accepted, refused and broken.
CALLS = f"""
SELECT 'call_' || CAST(event_id AS STRING) AS id,
  '{{"model":"' || {MODEL_OF_K} || '","messages":[{{"role":"user","content":"' || event_type || ' ' || CAST(k AS STRING) || '"}}]'
    || CASE WHEN k % 3 = 0 THEN ',"user":"body_' || CAST(user_id AS STRING) || '"' ELSE '' END
    || CASE WHEN k % 5 = 0 THEN ',"trace_id":"t' || CAST(k AS STRING) || '"' ELSE '' END
    || CASE WHEN k % 4 = 0 THEN ',"temperature":0.25,"max_tokens":64' ELSE '' END || '}}' AS request,
  CASE WHEN event_type = 'signup' THEN NULL
    WHEN event_type = 'error' THEN '{{"error":{{"message":"upstream ' || CAST(k AS STRING) || '"}}}}'
    ELSE '{{"model":"served","choices":[{{"message":{{"role":"assistant","content":"reply ' || CAST(k AS STRING) || '"}}}}]'
      || CASE WHEN k % 2 = 0 THEN ',"usage":{{"prompt_tokens":' || CAST(10 + k AS STRING) || ',"completion_tokens":' || CAST(5 + k AS STRING)
        || CASE WHEN k % 4 = 0 THEN ',"estimated_cost":0.5' ELSE '' END || '}}' ELSE '' END || '}}' END AS response,
  'h_' || CAST(user_id AS STRING) AS user_header,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
  CAST(floor(value) AS BIGINT) AS latency_ms,
  CASE WHEN event_type = 'signup' THEN 'socket hang up' END AS transport_error,
  ts AS created_at, event_type, k
FROM {EVENTS_K}
"""

# Generated and expected text: each answer with the turn before it.
TEXT_PAIRS = """
SELECT g.conv_id, g.turn, g.text AS generated, e.text AS expected
FROM conversations g JOIN conversations e ON g.conv_id = e.conv_id AND e.turn = g.turn - 1 WHERE g.role = 'assistant'
"""

# Versioned templates: one name per source, version numbers with gaps.
PROMPTS = """
SELECT source AS name, CAST(doc_id + 1 AS BIGINT) AS version, 'You write ' || lang || '.' AS system_prompt,
  'Summarise {{ title }} for {{user}}: ' || text AS user_template FROM documents
"""

# Judge output of every labelled document; coherence 0.25 to 6.25 crosses the allowed range.
JUDGED = """
SELECT CAST(doc_id AS STRING) AS id, '{"score":' || CAST(quality * 3 + toxic * 2 + doc_id % 2 AS STRING)
  || ',"task_type":"summarization","task_metrics":["coherence","fluency"],"coherence":' || CAST(doc_id % 7 AS STRING)
  || '.25,"fluency":4,"conciseness":3,"applicable_metrics":["faithfulness"],"faithfulness":3.14,"safety_status":"'
  || CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END || '"}' AS judge_json FROM labels
"""

# Ranked and relevant ids per order line.
RETRIEVAL = """
SELECT l_orderkey, l_linenumber, l_partkey,
  {A}(l_partkey % 9, l_suppkey % 9, l_orderkey % 9, l_partkey % 9, CAST(l_linenumber AS BIGINT)) AS retrieved_ids,
  {A}(l_partkey % 4, l_suppkey % 5) AS relevant_ids FROM lineitem
"""

SPARK_JSON, CHECK_JSON = "get_json_object(e.props, '$.k')", "json_extract_string(e.props, '$.k')"


def spark_sql(text: str) -> str:
    return text.replace("{J}", SPARK_JSON).replace("{A}", "array")


def check_sql(text: str) -> str:
    return text.replace("{J}", CHECK_JSON).replace("{A}", "list_value")


# Tables the views read; on the Spark side they are registered under a prefix of our own.
_SOURCE = re.compile(r"\b(FROM|JOIN) (events|conversations|documents|labels|lineitem)\b")
PREFIX = "calltrail_"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Evaluate a view text over the tables of ``folder``."""
    for name in sorted({m.group(2) for m in _SOURCE.finditer(text)}):
        table(spark, folder, name).createOrReplaceTempView(PREFIX + name)
    return spark.sql(_SOURCE.sub(rf"\1 {PREFIX}\2", spark_sql(text)))


def models(spark: SparkSession) -> DataFrame:
    return spark.sql(MODELS)


def unpriced(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, REQUESTS)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return estimate_cost(unpriced(spark, folder), models(spark))


def requests_over(events: DataFrame, spark: SparkSession) -> DataFrame:
    """The call log over another frame of events, such as a stream."""
    name = PREFIX + "arriving"
    events.createOrReplaceTempView(name)
    return estimate_cost(spark.sql(spark_sql(REQUESTS).replace("FROM events e", f"FROM {name} e")), models(spark))


def with_log(body: str, *extra: str) -> str:
    """SQL check text: the priced log as ``r`` (price list ``models``), further CTEs, then ``body``."""
    parts = [f"models AS ({MODELS})", f"req AS ({check_sql(REQUESTS)})", f"r AS ({PRICED})", *extra]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def with_view(text: str, body: str, *extra: str) -> str:
    """SQL check text over one view, as ``v``."""
    return "WITH " + ",\n".join([f"v AS ({check_sql(text)})", *extra]) + "\n" + body
