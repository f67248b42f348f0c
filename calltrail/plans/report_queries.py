"""Filters, pricing, reports and rollups over the call log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import messages as M
from ..operators import analytics as A
from ..operators import conversations as V
from ..operators import cost as C
from ..operators import filters as B
from ..sources.tables import load_tables
from .registry import END, LATE_END, LATE_START, START, query, stamp, stamp_sql, within_sql
from .views import models, requests, table, unpriced, view, with_log

IN_RANGE = within_sql()
ERR = "CASE WHEN status = 'error' THEN 1 ELSE 0 END"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def cents(expr: str, digits: int) -> str:
    """Half-up rounding, as the operators do it."""
    return f"floor(({expr}) * {10.0 ** digits} + 0.5) / CAST({10.0 ** digits} AS DOUBLE)"


@query("load_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in TABLES))
def _load(spark, folder):
    out = None
    for name, frame in load_tables(spark, folder, TABLES).items():
        counted = frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = counted if out is None else out.unionByName(counted)
    return out


# ---------------------------------------------------------------- filters

LIST_SQL = f"SELECT id, model, status, user_id, total_tokens, estimated_cost, {stamp_sql('created_at')} AS created_at FROM r WHERE "


def _listed(df):
    return df.select("id", "model", "status", "user_id", "total_tokens", "estimated_cost", stamp("created_at").alias("created_at"))


@query("filter_requests", with_log(LIST_SQL + f"""model = 'deepseek-ai/DeepSeek-V3' AND status = 'success'
  AND {within_sql(LATE_START, LATE_END)} AND estimated_cost >= 0.0002 AND estimated_cost <= 0.0005
  AND (input_messages ILIKE '%by user%' OR output_message ILIKE '%by user%' OR model ILIKE '%by user%')"""))
def _filter(spark, folder):
    return _listed(B.filter_requests(requests(spark, folder), model="deepseek-ai/DeepSeek-V3", status="success",
                                     start=LATE_START, end=LATE_END, min_cost=0.0002, max_cost=0.0005, search="By User"))


@query("search_requests", with_log(LIST_SQL + "(input_messages ILIKE '%uSer1_@EXAMPLE%' OR output_message ILIKE '%uSer1_@EXAMPLE%' OR model ILIKE '%uSer1_@EXAMPLE%')"))
def _search(spark, folder):
    return _listed(B.search_requests(requests(spark, folder), "uSer1_@EXAMPLE"))


@query("feedback_filter", with_log(LIST_SQL + "CAST(json_extract_string(feedback, '$.score') AS INT) = -1"))
def _feedback(spark, folder):
    return _listed(B.feedback_filter(requests(spark, folder), "negative"))


@query("eval_score_range", with_log(LIST_SQL + """CASE WHEN json_valid(evaluation) THEN
  TRY_CAST(json_extract_string(evaluation, '$.score') AS DOUBLE) END BETWEEN 2.5 AND 3.5"""))
def _eval_range(spark, folder):
    return _listed(B.eval_score_range(requests(spark, folder), 2.5, 3.5))


@query("user_requests", with_log(LIST_SQL + "user_id = 'user_11'"))
def _user(spark, folder):
    return _listed(B.filter_requests(requests(spark, folder), user_id="user_11"))


@query("search_conversations", with_log("""SELECT conversation_id AS id, CAST(count(*) AS BIGINT) AS total_messages FROM r
  WHERE conversation_id ILIKE '%CONV_1%' GROUP BY conversation_id"""))
def _search_conv(spark, folder):
    return B.search_conversations(V.conversation_rollup(requests(spark, folder)), "CONV_1").select("id", "total_messages")


@query("lookup_requests", with_log("""SELECT k.key, coalesce(a.id, b.id) AS id, coalesce(a.model, b.model) AS model
  FROM k LEFT JOIN r a ON a.id = k.key LEFT JOIN r b ON a.id IS NULL AND b.span_id = k.key WHERE coalesce(a.id, b.id) IS NOT NULL""",
  "k AS (SELECT CASE event_type WHEN 'click' THEN 'req_' WHEN 'view' THEN 'span_' ELSE 'none_' END || CAST(event_id AS VARCHAR) AS key FROM events)"))
def _lookup(spark, folder):
    log = requests(spark, folder)
    keys = view(spark, folder, "SELECT CASE event_type WHEN 'click' THEN 'req_' WHEN 'view' THEN 'span_' ELSE 'none_' END || CAST(event_id AS STRING) AS key FROM events")
    return B.lookup_requests(log, keys).select("key", "id", "model")


@query("row_labels", with_log(f"""SELECT id, CASE WHEN model = '' THEN 'Unknown' ELSE regexp_replace(model, '^.*/', '') END AS model_leaf,
  t AS task_label, CASE t WHEN 'code_generation' THEN 'Code Generation' WHEN 'helpfulness' THEN 'Helpfulness' ELSE 'General' END AS task_title,
  CASE WHEN s >= 4 THEN 'high' WHEN s >= 3 THEN 'mid' ELSE 'low' END AS score_band
  FROM (SELECT id, model, coalesce(CASE WHEN json_valid(evaluation) THEN json_extract_string(evaluation, '$.task_type') END,
    CASE WHEN json_valid(evaluation) THEN json_extract_string(evaluation, '$.category') END, 'general') AS t,
    coalesce(CASE WHEN json_valid(evaluation) THEN CAST(json_extract_string(evaluation, '$.score') AS DOUBLE) END, 0) AS s FROM r) z"""))
def _labels(spark, folder):
    label = M.task_label("evaluation")
    return unpriced(spark, folder).select(
        "id", M.model_leaf("model").alias("model_leaf"), label.alias("task_label"), M.task_title(label).alias("task_title"),
        M.score_band(F.get_json_object("evaluation", "$.score").try_cast("double")).alias("score_band"))


@query("page_requests", with_log("""SELECT id, latency_ms, status FROM r ORDER BY latency_ms DESC, id DESC LIMIT 50 OFFSET 100"""))
def _page(spark, folder):
    rows, _ = B.page(requests(spark, folder), page=3, limit=50, sort_by="latency_ms")
    return rows.select("id", "latency_ms", "status")


@query("page_totals", with_log("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(3 AS BIGINT) AS page, CAST(50 AS BIGINT) AS "limit",
  CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM r WHERE status = 'error'"""))
def _page_totals(spark, folder):
    _, info = B.page(B.filter_requests(requests(spark, folder), status="error"), page=3, limit=50)
    return info


@query("page_after", with_log("""SELECT id, latency_ms FROM r WHERE latency_ms < 900 OR (latency_ms = 900 AND id < 'req_5')
  ORDER BY latency_ms DESC, id DESC LIMIT 500"""))
def _page_after(spark, folder):
    rows = B.page_after(requests(spark, folder), 900, "req_5", limit=500, sort_by="latency_ms")
    return rows.select("id", "latency_ms")


@query("recent_requests", with_log(f"SELECT id, {stamp_sql('created_at')} AS created_at FROM r ORDER BY r.created_at DESC, id DESC LIMIT 5"))
def _recent(spark, folder):
    return B.recent_requests(requests(spark, folder)).select("id", stamp("created_at").alias("created_at"))


# ---------------------------------------------------------------- pricing

@query("estimate_cost", with_log("SELECT id, model, prompt_tokens, completion_tokens, estimated_cost FROM r"))
def _cost(spark, folder):
    return requests(spark, folder).select("id", "model", "prompt_tokens", "completion_tokens", "estimated_cost")


# Old costs are the latency in thousandths, so that rows keeping their cost can be told apart.
REPRICED = f"""p AS (SELECT q.id, q.conversation_id, CASE WHEN m.id IS NOT NULL THEN
  {cents('q.prompt_tokens * m.input_cost_per_million / CAST(1000000.0 AS DOUBLE) + q.completion_tokens * m.output_cost_per_million / CAST(1000000.0 AS DOUBLE)', 6)} ELSE q.latency_ms / 1000.0 END AS estimated_cost
  FROM req q LEFT JOIN models m ON q.model = m.id)"""


def _old_costs(spark, folder):
    return unpriced(spark, folder).withColumn("estimated_cost", F.col("latency_ms") / 1000.0)


@query("recalculate_costs", with_log("SELECT id, estimated_cost FROM p", REPRICED))
def _reprice(spark, folder):
    return C.recalculate_costs(_old_costs(spark, folder), models(spark))[0].select("id", "estimated_cost")


@query("recalculate_conversations", with_log("""SELECT conversation_id AS id, CAST(count(*) AS BIGINT) AS total_messages, round(sum(estimated_cost), 6) AS total_cost
  FROM p WHERE conversation_id IS NOT NULL GROUP BY conversation_id""", REPRICED))
def _reprice_conv(spark, folder):
    conv = C.recalculate_costs(_old_costs(spark, folder), models(spark))[1]
    return conv.select("id", "total_messages", F.round("total_cost", 6).alias("total_cost"))


# ---------------------------------------------------------------- reports

@query("overview", with_log(f"""SELECT CAST(n AS BIGINT) AS total_requests, cost AS total_cost, floor(lat + 0.5) AS avg_latency,
  CASE WHEN n > 0 THEN {cents('errors / CAST(n AS DOUBLE) * 100.0', 2)} ELSE 0.0 END AS error_rate,
  CAST(tt AS BIGINT) AS total_tokens, CAST(pt AS BIGINT) AS total_prompt_tokens, CAST(ct AS BIGINT) AS total_completion_tokens,
  CASE WHEN n0 = 0 THEN CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END ELSE {cents('(n - n0) / CAST(n0 AS DOUBLE) * 100.0', 2)} END AS requests_change,
  CASE WHEN c0 = 0 THEN CASE WHEN cost > 0 THEN 100.0 ELSE 0.0 END ELSE {cents('(cost - c0) / c0 * 100.0', 2)} END AS cost_change
  FROM cur, prev""",
  f"cur AS (SELECT count(*) AS n, round(sum(estimated_cost), 6) AS cost, avg(latency_ms) AS lat, sum({ERR}) AS errors, sum(total_tokens) AS tt, sum(prompt_tokens) AS pt, sum(completion_tokens) AS ct FROM r WHERE {within_sql(LATE_START, LATE_END)})",
  f"prev AS (SELECT count(*) AS n0, round(coalesce(sum(estimated_cost), 0), 6) AS c0 FROM r WHERE {within_sql('2023-12-31 23:59:59.999', '2024-01-15 23:59:59.999')})"))
def _overview(spark, folder):
    return A.overview(requests(spark, folder), LATE_START, LATE_END)


def _buckets(fmt):
    return with_log(f"SELECT strftime(created_at, '{fmt}') AS date, model, round(sum(estimated_cost), 6) AS cost FROM r WHERE {IN_RANGE} GROUP BY 1, 2")


@query("cost_over_time_daily", _buckets("%Y-%m-%d"))
def _cost_daily(spark, folder):
    return A.cost_over_time(requests(spark, folder), START, END)


@query("cost_over_time_hourly", _buckets("%Y-%m-%dT%H:00:00"))
def _cost_hourly(spark, folder):
    return A.cost_over_time(requests(spark, folder), START, END, "hourly")


@query("token_usage", with_log(f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM r WHERE {IN_RANGE} GROUP BY 1"""))
def _tokens(spark, folder):
    return A.token_usage(requests(spark, folder), START, END)


USAGE_SQL = f"""u AS (SELECT model, CAST(count(*) AS BIGINT) AS requests, round(sum(estimated_cost), 6) AS cost,
  CAST(sum(total_tokens) AS BIGINT) AS tokens, round(avg(latency_ms)) AS avg_latency FROM r WHERE {IN_RANGE} GROUP BY model)"""


@query("model_usage", with_log("SELECT * FROM u", USAGE_SQL))
def _usage(spark, folder):
    return A.model_usage(requests(spark, folder), START, END)


@query("top_models", with_log("SELECT model, requests FROM u ORDER BY requests DESC, model LIMIT 8", USAGE_SQL))
def _top_models(spark, folder):
    return A.top_models(requests(spark, folder), START, END)


@query("cost_share", with_log("""SELECT model, requests, cost, CASE WHEN t > 0 THEN round(cost / t * 100, 1) ELSE 0.0 END AS cost_pct
  FROM u, (SELECT sum(cost) AS t FROM u) x""", USAGE_SQL))
def _share(spark, folder):
    return A.cost_share(requests(spark, folder), START, END)


def _rank(p):
    return f"min(CASE WHEN rn >= ceil(CAST({p} AS DOUBLE) * n) THEN latency_ms END)"


@query("latency_stats", with_log(f"""SELECT date, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99, floor(avg(latency_ms) + 0.5) AS avg
  FROM (SELECT strftime(created_at, '%Y-%m-%d') AS date, latency_ms, row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY latency_ms) AS rn,
    count(*) OVER (PARTITION BY strftime(created_at, '%Y-%m-%d')) AS n FROM r WHERE {IN_RANGE} AND status <> 'error') z GROUP BY date"""))
def _latency(spark, folder):
    return A.latency_stats(requests(spark, folder), START, END)


@query("error_trend", with_log(f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(sum({ERR}) AS BIGINT) AS error_count, CAST(count(*) AS BIGINT) AS total_count,
  round(sum({ERR}) / CAST(count(*) AS DOUBLE) * 100, 2) AS error_rate FROM r WHERE {IN_RANGE} GROUP BY 1"""))
def _errors(spark, folder):
    return A.error_trend(requests(spark, folder), START, END)


@query("top_errors", with_log(f"""SELECT error_message, CAST(count(*) AS BIGINT) AS count FROM r WHERE {IN_RANGE} AND status = 'error' AND error_message IS NOT NULL
  GROUP BY error_message ORDER BY count DESC, error_message LIMIT 10"""))
def _top_errors(spark, folder):
    return A.top_errors(requests(spark, folder), START, END)


@query("user_stats", with_log(f"""SELECT coalesce(user_id, 'anonymous') AS user_id, CAST(count(*) AS BIGINT) AS requests, round(sum(estimated_cost), 6) AS cost,
  CAST(sum(total_tokens) AS BIGINT) AS tokens FROM r WHERE {IN_RANGE} GROUP BY r.user_id"""))
def _users(spark, folder):
    return A.user_stats(requests(spark, folder), START, END)


@query("daily_stats", with_log(f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, model, CAST(count(*) AS BIGINT) AS total_requests,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, round(sum(estimated_cost), 6) AS total_cost,
  {cents('avg(latency_ms)', 6)} AS avg_latency_ms, CAST(sum({ERR}) AS BIGINT) AS error_count FROM r GROUP BY 1, 2"""))
def _daily(spark, folder):
    return A.daily_stats(requests(spark, folder))


@query("table_totals", with_log("SELECT CAST(count(*) AS BIGINT) AS total_requests FROM r"))
def _totals(spark, folder):
    return A.table_totals(requests(spark, folder))


@query("tokens_per_request", with_log(f"SELECT floor(sum(total_tokens) / CAST(count(*) AS DOUBLE) + 0.5) AS tokens_per_request FROM r WHERE {IN_RANGE}"))
def _per_request(spark, folder):
    return A.tokens_per_request(requests(spark, folder), START, END)


FILLED = "d AS (SELECT strftime(g, '%Y-%m-%d') AS date FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) t(g))"


@query("gap_fill_cost", with_log("""SELECT d.date, coalesce(round(c.cost, 6), 0) AS cost FROM d LEFT JOIN
  (SELECT strftime(created_at, '%Y-%m-%d') AS date, sum(estimated_cost) AS cost FROM r GROUP BY 1) c ON d.date = c.date""", FILLED))
def _gap_cost(spark, folder):
    series = A.cost_over_time(requests(spark, folder), "2023-12-28", "2024-02-03")
    filled = A.gap_fill_daily(series, "2023-12-28", "2024-02-03", "date", ["cost"])
    return filled.withColumn("cost", F.round("cost", 6))


@query("gap_fill_errors", with_log(f"""SELECT d.date, CAST(coalesce(c.e, 0) AS BIGINT) AS error_count, CAST(coalesce(c.n, 0) AS BIGINT) AS total_count FROM d LEFT JOIN
  (SELECT strftime(created_at, '%Y-%m-%d') AS date, sum({ERR}) AS e, count(*) AS n FROM r GROUP BY 1) c ON d.date = c.date""", FILLED))
def _gap_errors(spark, folder):
    series = A.error_trend(requests(spark, folder), "2023-12-28", "2024-02-03")
    return A.gap_fill_daily(series, "2023-12-28", "2024-02-03", "date", ["error_count", "total_count"])


@query("gap_fill_tokens", with_log("""SELECT d.date, CAST(coalesce(c.p, 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(c.t, 0) AS BIGINT) AS total_tokens FROM d LEFT JOIN
  (SELECT strftime(created_at, '%Y-%m-%d') AS date, sum(prompt_tokens) AS p, sum(total_tokens) AS t FROM r GROUP BY 1) c ON d.date = c.date""", FILLED))
def _gap_tokens(spark, folder):
    series = A.token_usage(requests(spark, folder), "2023-12-28", "2024-02-03")
    return A.gap_fill_daily(series, "2023-12-28", "2024-02-03", "date", ["prompt_tokens", "total_tokens"])


@query("gap_fill_latency", with_log(f"""SELECT d.date, CAST(coalesce(p50, 0) AS BIGINT) AS p50, CAST(coalesce(p95, 0) AS BIGINT) AS p95 FROM d LEFT JOIN
  (SELECT date, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95 FROM (SELECT strftime(created_at, '%Y-%m-%d') AS date, latency_ms,
    row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY strftime(created_at, '%Y-%m-%d')) AS n
    FROM r WHERE status <> 'error') z GROUP BY date) c ON d.date = c.date""", FILLED))
def _gap_latency(spark, folder):
    series = A.latency_stats(requests(spark, folder), "2023-12-28", "2024-02-03")
    return A.gap_fill_daily(series, "2023-12-28", "2024-02-03", "date", ["p50", "p95"])


# ---------------------------------------------------------------- conversations

CONV_SQL = f"""SELECT conversation_id AS id, CAST(count(*) AS BIGINT) AS total_messages, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(estimated_cost), 6) AS total_cost, {stamp_sql('min(created_at)')} AS first_message_at, {stamp_sql('max(created_at)')} AS last_message_at
  FROM r WHERE conversation_id IS NOT NULL GROUP BY conversation_id"""


def published_rollup(df):
    return df.select("id", "total_messages", "total_tokens", F.round("total_cost", 6).alias("total_cost"),
                     stamp("first_message_at").alias("first_message_at"), stamp("last_message_at").alias("last_message_at"))


@query("conversation_rollup", with_log(CONV_SQL))
def _rollup(spark, folder):
    return published_rollup(V.conversation_rollup(requests(spark, folder)))


@query("page_conversations", with_log(f"SELECT * FROM c ORDER BY last_message_at DESC, id DESC LIMIT 50", f"c AS ({CONV_SQL})"))
def _page_conv(spark, folder):
    rows, _ = B.page(V.conversation_rollup(requests(spark, folder)), kind="conversations")
    return published_rollup(rows)


@query("conversation_requests", with_log(f"""SELECT conversation_id, id, {stamp_sql('created_at')} AS created_at FROM r
  WHERE conversation_id IN (SELECT 'conv_' || CAST(o_custkey AS VARCHAR) || '_1' FROM orders)"""))
def _conv_requests(spark, folder):
    wanted = table(spark, folder, "orders").select(F.concat(F.lit("conv_"), F.col("o_custkey").cast("string"), F.lit("_1")).alias("id"))
    return V.conversation_requests(requests(spark, folder), wanted).select("conversation_id", "id", stamp("created_at").alias("created_at"))


@query("conversation_replay", with_log("""SELECT conversation_id, id, CAST(position AS INT) AS position, role, content, tokens, cost FROM (
  SELECT conversation_id, id, 0 AS position, 'user' AS role, CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[1].content')
    ELSE json_extract_string(input_messages, '$[0].content') END AS content, CAST(NULL AS BIGINT) AS tokens, CAST(NULL AS DOUBLE) AS cost FROM r WHERE conversation_id IS NOT NULL
  UNION ALL SELECT conversation_id, id, 1, 'assistant', coalesce(json_extract_string(output_message, '$.content'), json_extract_string(raw_response, '$.choices[0].message.content')),
    completion_tokens, estimated_cost FROM r WHERE conversation_id IS NOT NULL AND (output_message IS NOT NULL OR raw_response IS NOT NULL)) z"""))
def _conv_replay(spark, folder):
    return V.conversation_replay(requests(spark, folder)).select("conversation_id", "id", "position", "role", "content", "tokens", "cost")


@query("playground_session", with_log("""SELECT conversation_id, round(coalesce(sum(CASE WHEN status = 'success' THEN estimated_cost END), 0), 6) AS total_cost,
  CAST(coalesce(sum(CASE WHEN status = 'success' THEN total_tokens END), 0) AS BIGINT) AS total_tokens, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS turns
  FROM r WHERE tags LIKE '%"playground"%' AND conversation_id IS NOT NULL GROUP BY conversation_id"""))
def _playground(spark, folder):
    return V.playground_session(requests(spark, folder)).withColumn("total_cost", F.round("total_cost", 6))


@query("playground_runs", with_log(f"""SELECT id, total_tokens, latency_ms, CASE WHEN completion_tokens > 0 THEN {cents('completion_tokens / (latency_ms / CAST(1000.0 AS DOUBLE))', 1)} ELSE 0.0 END AS tokens_per_second
  FROM r WHERE tags LIKE '%"playground"%'"""))
def _runs(spark, folder):
    return V.playground_runs(requests(spark, folder)).select("id", "total_tokens", "latency_ms", "tokens_per_second")


# Requests in the range of each preset, as seen from one moment.
_NOW = "2024-01-20 15:30:00"
_FIRST = {"24h": "2024-01-19 15:30:00", "7d": "2024-01-14 00:00:00", "30d": "2023-12-22 00:00:00", "90d": "2023-10-23 00:00:00", "default": "2024-01-13 15:30:00"}


@query("requests_in_presets", with_log(" UNION ALL ".join(
    f"SELECT '{name}' AS preset, CAST(count(*) AS BIGINT) AS n_requests, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM r WHERE {within_sql(first, _NOW)}" for name, first in _FIRST.items())))
def _presets(spark, folder):
    log, out = unpriced(spark, folder), None
    for name in _FIRST:
        start, end = B.resolve_date_range(datetime.fromisoformat(_NOW), preset=None if name == "default" else name)
        part = B.between(log, str(start), str(end)).agg(F.lit(name).alias("preset"), F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
        out = part if out is None else out.unionByName(part)
    return out
