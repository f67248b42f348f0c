"""Trace rollups, trees, replays, approval checks, evaluation reports and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import filters as B
from ..operators import traces as T
from ..operators import trees as N
from ..streaming.alerts import alerts
from .registry import END, LATE_END, LATE_START, START, query, stamp, stamp_sql, within_sql
from .report_queries import cents
from .views import requests, unpriced, with_log

ROOT_SQL = "(parent_span_id IS NULL OR parent_span_id = '' OR parent_span_id = 'root')"
HAS_TRACE = "trace_id IS NOT NULL AND trace_id <> ''"
FAILED_SHARE = "count(*) FILTER (status = 'error') / CAST(count(*) AS DOUBLE) * 100.0"


def _sessions_sql(start=None, end=None):
    inside = f"AND {within_sql(start, end)}" if start else ""
    return f"""SELECT t.trace_id, {stamp_sql('first_at')} AS first_span_at, {stamp_sql('last_at')} AS last_span_at, total_spans, total_latency_ms, total_cost, total_tokens,
      coalesce(root.span_name, head.span_name, 'Trace Session') AS name, coalesce(root.model, head.model, 'unknown') AS model
      FROM (SELECT trace_id, min(created_at) AS first_at, max(created_at) AS last_at, CAST(count(*) AS BIGINT) AS total_spans, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms,
        round(sum(estimated_cost), 6) AS total_cost, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM r WHERE {HAS_TRACE} {inside} GROUP BY trace_id) t
      LEFT JOIN (SELECT trace_id, span_name, model, row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) AS rn FROM r WHERE {HAS_TRACE} AND {ROOT_SQL}) root ON root.trace_id = t.trace_id AND root.rn = 1
      LEFT JOIN (SELECT trace_id, span_name, model, row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) AS rn FROM r WHERE {HAS_TRACE}) head ON head.trace_id = t.trace_id AND head.rn = 1"""


def _published(df):
    return df.withColumn("first_span_at", stamp("first_span_at")).withColumn("last_span_at", stamp("last_span_at"))


@query("trace_sessions", with_log(_sessions_sql()))
def _sessions(spark, folder):
    return _published(T.trace_sessions(requests(spark, folder)))


@query("trace_sessions_in_range", with_log(_sessions_sql(LATE_START, LATE_END)))
def _sessions_range(spark, folder):
    return _published(T.trace_sessions(requests(spark, folder), LATE_START, LATE_END))


@query("page_traces", with_log("SELECT * FROM s ORDER BY last_span_at DESC, trace_id DESC LIMIT 20", f"s AS ({_sessions_sql()})"))
def _page_traces(spark, folder):
    rows, _ = B.page(T.trace_sessions(requests(spark, folder)), kind="traces")
    return _published(rows)


@query("trace_count", with_log(f"SELECT CAST(count(DISTINCT trace_id) AS BIGINT) AS total FROM r WHERE {HAS_TRACE} AND {within_sql(LATE_START, LATE_END)}"))
def _count(spark, folder):
    return T.trace_count(requests(spark, folder), LATE_START, LATE_END)


AGENT_SQL = f"""a AS (SELECT t.trace_id, coalesce(root.id, head.id) AS root_id,
  CASE WHEN tools > 0 THEN tools_ok / CAST(tools AS DOUBLE) ELSE 1.0 END AS tool_success_rate, spans AS iteration_count,
  CASE WHEN coalesce(root.status, head.status) = 'success' THEN 1.0 ELSE 0.0 END AS goal_completion_rate,
  CASE WHEN tools > 0 THEN tools_ok / CAST(tools AS DOUBLE) WHEN ok = spans THEN 1.0 ELSE 0.5 END AS planning_accuracy,
  CASE WHEN tools > 0 THEN tools_ok / CAST(tools AS DOUBLE) ELSE 1.0 END AS tool_selection_accuracy
  FROM (SELECT trace_id, CAST(count(*) AS BIGINT) AS spans, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (span_type = 'tool') AS tools,
    count(*) FILTER (span_type = 'tool' AND status = 'success') AS tools_ok FROM r WHERE {HAS_TRACE} GROUP BY trace_id) t
  LEFT JOIN (SELECT trace_id, id, status, row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) AS rn FROM r WHERE {HAS_TRACE} AND ({ROOT_SQL} OR span_type = 'agent')) root ON root.trace_id = t.trace_id AND root.rn = 1
  LEFT JOIN (SELECT trace_id, id, status, row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) AS rn FROM r WHERE {HAS_TRACE}) head ON head.trace_id = t.trace_id AND head.rn = 1)"""
AGENT_OUT = """SELECT trace_id, root_id, CAST(tool_success_rate AS DOUBLE) AS tool_success_rate, iteration_count, CAST(goal_completion_rate AS DOUBLE) AS goal_completion_rate,
  CAST(planning_accuracy AS DOUBLE) AS planning_accuracy, CAST(tool_selection_accuracy AS DOUBLE) AS tool_selection_accuracy FROM a"""


@query("agent_metrics", with_log(AGENT_OUT, AGENT_SQL))
def _agents(spark, folder):
    return T.agent_metrics(requests(spark, folder))


@query("attach_agent_metrics", with_log("""SELECT r.id, CAST(coalesce(a.tool_success_rate, CASE WHEN json_valid(r.evaluation) THEN CAST(json_extract_string(r.evaluation, '$.tool_success_rate') AS DOUBLE) END) AS DOUBLE) AS tool_success_rate,
  coalesce(a.iteration_count, CASE WHEN json_valid(r.evaluation) THEN CAST(json_extract_string(r.evaluation, '$.iteration_count') AS BIGINT) END) AS iteration_count,
  CASE WHEN json_valid(r.evaluation) THEN CAST(json_extract_string(r.evaluation, '$.score') AS DOUBLE) END AS score
  FROM r LEFT JOIN a ON a.root_id = r.id""", AGENT_SQL))
def _attached(spark, folder):
    rows = T.with_agent_metrics(requests(spark, folder))
    parsed = F.from_json("evaluation", "tool_success_rate double, iteration_count long, score double")
    return rows.select("id", parsed.alias("e")).select("id", "e.*")


TOOLS_SQL = f"""o AS (SELECT trace_id, created_at, id, CASE WHEN output_message IS NOT NULL THEN json_extract_string(output_message, '$.content') ELSE raw_response END AS text
  FROM r WHERE {HAS_TRACE} AND span_type = 'tool')"""


@query("tool_outputs", with_log("SELECT trace_id, id, text FROM o WHERE text IS NOT NULL", TOOLS_SQL))
def _tool_outputs(spark, folder):
    return T.tool_outputs(requests(spark, folder)).select("trace_id", "id", "text")


@query("gather_tool_context", with_log("SELECT trace_id, string_agg(text, chr(10) || chr(10) ORDER BY created_at, id) AS context FROM o WHERE text IS NOT NULL GROUP BY trace_id", TOOLS_SQL))
def _context(spark, folder):
    return T.gather_tool_context(requests(spark, folder))


@query("subsequent_spans", with_log(f"""SELECT s.trace_id, s.id, {stamp_sql('s.created_at')} AS created_at FROM r s WHERE EXISTS
  (SELECT 1 FROM r c WHERE c.span_type = 'check' AND c.trace_id = s.trace_id AND s.created_at > c.created_at)"""))
def _later(spark, folder):
    log = requests(spark, folder)
    return T.subsequent_spans(log, log.filter(F.col("span_type") == "check")).select("trace_id", "id", stamp("created_at").alias("created_at"))


@query("spans_after_checks", with_log("""SELECT c.id AS anchor_id, s.trace_id, s.id FROM r s JOIN r c ON c.span_type = 'check' AND c.trace_id = s.trace_id AND s.created_at > c.created_at"""))
def _after_each(spark, folder):
    log = requests(spark, folder)
    return T.spans_after(log, log.filter(F.col("span_type") == "check")).select("anchor_id", "trace_id", "id")


@query("approval_queue", with_log("""SELECT id, trace_id, status, CASE WHEN status IN ('awaiting_approval', 'paused') THEN 'pending' WHEN status = 'success' THEN 'approved' ELSE 'rejected' END AS state
  FROM r WHERE span_type = 'check' AND status IN ('awaiting_approval', 'paused', 'success', 'rejected')"""))
def _approvals(spark, folder):
    return T.approval_queue(requests(spark, folder)).select("id", "trace_id", "status", "state")


# Some checks are answered a day later, so that they are the newest span of their trace.
@query("stalled_checks", with_log("""SELECT c.id, c.trace_id, c.status FROM l c WHERE c.span_type = 'check' AND c.status IN ('success', 'rejected')
  AND NOT EXISTS (SELECT 1 FROM l s WHERE s.trace_id = c.trace_id AND s.created_at > c.created_at)""",
  "l AS (SELECT * REPLACE (CASE WHEN span_type = 'check' AND right(id, 1) IN ('1', '3', '8') THEN created_at + INTERVAL 1 DAY ELSE created_at END AS created_at) FROM r)"))
def _stalled(spark, folder):
    late = (F.col("span_type") == "check") & F.right("id", F.lit(1)).isin("1", "3", "8")
    log = requests(spark, folder).withColumn("created_at", F.when(late, F.col("created_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("created_at")))
    return T.stalled_checks(log).select("id", "trace_id", "status")


TREE_SQL = f"""n AS (SELECT s.trace_id, s.id, s.span_id, s.created_at, p.id AS parent_id FROM r s LEFT JOIN r p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id
    AND s.parent_span_id NOT IN ('', 'root') WHERE s.trace_id IS NOT NULL AND s.trace_id <> ''),
  t AS (SELECT trace_id, id, span_id, parent_id, id AS root_id, 0 AS depth FROM n WHERE parent_id IS NULL
    UNION ALL SELECT n.trace_id, n.id, n.span_id, n.parent_id, t.root_id, t.depth + 1 FROM n JOIN t ON n.parent_id = t.id)"""


@query("span_tree", with_log("SELECT trace_id, id, span_id, parent_id, root_id, CAST(depth AS INT) AS depth FROM t", TREE_SQL))
def _tree(spark, folder):
    tree, _ = T.span_tree(unpriced(spark, folder))
    return T.flatten_tree(tree)


NUMBERS_SQL = """p AS (SELECT n.trace_id, n.id, n.span_id, n.parent_id, n.id AS root_id, 0 AS depth, [{'at': n.created_at, 'id': n.id}] AS path FROM n WHERE parent_id IS NULL
    UNION ALL SELECT n.trace_id, n.id, n.span_id, n.parent_id, p.root_id, p.depth + 1, list_append(p.path, {'at': n.created_at, 'id': n.id}) FROM n JOIN p ON n.parent_id = p.id),
  u AS (SELECT a.id, count(*) AS size FROM (SELECT unnest(list_transform(path, lambda s: s.id)) AS id FROM p) a GROUP BY a.id),
  e AS (SELECT p.trace_id, p.id, p.span_id, p.parent_id, p.root_id, p.depth, row_number() OVER (PARTITION BY p.trace_id ORDER BY p.path) - 1 AS enter, u.size FROM p JOIN u USING (id))"""


@query("span_tree_numbers", with_log("""SELECT trace_id, id, parent_id, root_id, CAST(depth AS INT) AS depth, CAST(enter AS BIGINT) AS enter,
  CAST(enter + size - 1 AS BIGINT) AS leave, CAST(size AS BIGINT) AS size FROM e""", TREE_SQL, NUMBERS_SQL))
def _numbers(spark, folder):
    tree, _ = N.number_spans(unpriced(spark, folder))
    return tree.select("trace_id", "id", "parent_id", "root_id", "depth", "enter", "leave", "size")


@query("span_children", with_log("""SELECT trace_id, parent_id, id, CAST(enter AS BIGINT) AS enter, CAST(lead(enter) OVER (PARTITION BY trace_id, parent_id ORDER BY enter) AS BIGINT) AS next_enter
  FROM e WHERE parent_id IS NOT NULL""", TREE_SQL, NUMBERS_SQL))
def _children(spark, folder):
    return N.children(N.number_spans(unpriced(spark, folder))[0])


@query("span_tree_nested", with_log("""SELECT trace_id, CAST(enter AS BIGINT) AS enter, '{"id":"' || id || '",' || CASE WHEN span_id IS NULL THEN '' ELSE '"span_id":"' || span_id || '",' END || '"children":['
    || repeat(']}', depth - coalesce(after, 0) + 1) || CASE WHEN after <= depth THEN ',' ELSE '' END AS part
  FROM (SELECT *, lead(depth) OVER (PARTITION BY trace_id ORDER BY enter) AS after FROM e) z""", TREE_SQL, NUMBERS_SQL))
def _nested(spark, folder):
    return N.nested_parts(N.number_spans(unpriced(spark, folder))[0])


@query("split_tool_io", with_log("""SELECT id, 'q' || regexp_extract(input_messages, 'Input: q([0-9]+)', 1) AS tool_input,
  'rows ' || regexp_extract(input_messages, 'nOutput: rows ([0-9]+)', 1) AS tool_output FROM r WHERE span_type = 'tool'"""))
def _tool_io(spark, folder):
    rows = unpriced(spark, folder).filter(F.col("span_type") == "tool")
    return T.split_tool_io(rows).select("id", "tool_input", "tool_output")


@query("trace_replay", with_log(f"""SELECT trace_id, id, CAST(position AS INT) AS position, role, content, tokens, cost, tool_input, tool_output, error FROM (
  SELECT trace_id, id, 0 AS position, 'user' AS role, CASE WHEN span_type = 'check' THEN '[Verification Check: ' || span_name || '] ' ELSE '' END || json_extract_string(input_messages, '$[1].content') AS content,
    CAST(NULL AS BIGINT) AS tokens, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS tool_input, CAST(NULL AS VARCHAR) AS tool_output, CAST(NULL AS VARCHAR) AS error
    FROM r WHERE {HAS_TRACE} AND span_type IN ('llm', 'agent', 'check')
  UNION ALL SELECT trace_id, id, 1, 'assistant', json_extract_string(output_message, '$.content'), completion_tokens, estimated_cost, NULL, NULL, NULL
    FROM r WHERE {HAS_TRACE} AND span_type IN ('llm', 'agent') AND output_message IS NOT NULL
  UNION ALL SELECT trace_id, id, 1, 'assistant', CASE status WHEN 'success' THEN '✅ Check approved.' WHEN 'rejected' THEN '❌ Check rejected.' ELSE '⏳ Awaiting review/approval.' END, NULL, NULL, NULL, NULL, NULL
    FROM r WHERE {HAS_TRACE} AND span_type = 'check' AND status IN ('success', 'rejected', 'awaiting_approval', 'paused')
  UNION ALL SELECT trace_id, id, 0, 'tool', NULL, NULL, NULL, 'q' || regexp_extract(input_messages, 'Input: q([0-9]+)', 1), 'rows ' || regexp_extract(input_messages, 'nOutput: rows ([0-9]+)', 1), error_message
    FROM r WHERE {HAS_TRACE} AND span_type = 'tool') z"""))
def _replay(spark, folder):
    return T.trace_replay(requests(spark, folder)).drop("created_at", "span_id", "span_name")


@query("playground_payload", with_log("""SELECT id, model, coalesce(temperature, 0.7) AS temperature, CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[0].content')
    ELSE 'You are a helpful and clear AI assistant.' END AS system_prompt,
  CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[1].content') ELSE json_extract_string(input_messages, '$[0].content') END
    || CASE WHEN output_message IS NOT NULL THEN '|' || json_extract_string(output_message, '$.content') ELSE '' END AS dialogue FROM r"""))
def _payload(spark, folder):
    rows = T.playground_payload(unpriced(spark, folder))
    return rows.select("id", "model", "temperature", "system_prompt", F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("dialogue"))


# ---------------------------------------------------------------- evaluation report

def _eval_sql():
    def num(k, src="evaluation"):
        return f"TRY_CAST(json_extract_string({src}, '$.{k}') AS DOUBLE)"

    def mean(k, member, n, digits, scale=1):
        return f"CASE WHEN {n} > 0 THEN {cents(f'round(coalesce(sum(CASE WHEN {member} THEN {k} END), 0), 9) / CAST({n} AS DOUBLE) * {scale}.0', digits)} ELSE 0.0 END"

    keys = E.RAG_METRICS + E.TEXT_METRICS + ("hallucination_rate",) + E.AGENT_METRICS
    parsed = ", ".join(f"CASE WHEN json_valid(evaluation) THEN {num(k)} END AS {k}" for k in dict.fromkeys(keys))
    rag = "(faithfulness IS NOT NULL OR answer_relevancy IS NOT NULL OR context_precision IS NOT NULL OR context_recall IS NOT NULL OR recall_at_k IS NOT NULL)"
    txt = "(exact_match IS NOT NULL OR f1_score IS NOT NULL OR bleu IS NOT NULL)"
    agent = "(iteration_count IS NOT NULL OR tool_success_rate IS NOT NULL)"
    n_rag, n_txt, n_agent = (f"count(*) FILTER ({m})" for m in (rag, txt, agent))
    out = ["CAST(count(*) AS BIGINT) AS total_requests", "CAST(count(*) FILTER (status = 'error') AS BIGINT) AS failed_requests",
           f"{cents(FAILED_SHARE, 2)} AS error_rate",
           f"{cents('count(*) / CAST(43200.0 AS DOUBLE)', 2)} AS throughput",
           "floor(sum(latency_ms) / CAST(count(*) AS DOUBLE) + 0.5) AS avg_latency", f"{cents('round(sum(estimated_cost), 9)', 4)} AS total_cost",
           "CAST(sum(total_tokens) AS BIGINT) AS total_tokens", f"{cents('sum(rating) / CAST(count(rating) AS DOUBLE)', 1)} AS avg_rating",
           "CAST(count(rating) AS BIGINT) AS rating_count",
           "floor(count(*) FILTER (done = 'true') / CAST(count(feedback) AS DOUBLE) * 100.0 + 0.5) AS task_success_rate",
           f"{mean('exact_match', txt, n_txt, 0, 100)} AS accuracy"]
    out += [f"{mean(k, rag, n_rag, 2 if k in E.RETRIEVAL_METRICS else 1)} AS {k}" for k in E.RAG_METRICS]
    out += [f"{mean(k, txt, n_txt, 2)} AS {k}" for k in E.TEXT_METRICS]
    out.append(f"{mean('hallucination_rate', 'hallucination_rate IS NOT NULL', 'count(hallucination_rate)', 2)} AS hallucination_rate")
    out += [f"{mean(k, agent, n_agent, 1 if k == 'iteration_count' else 2)} AS {'avg_iterations' if k == 'iteration_count' else k}" for k in E.AGENT_METRICS]
    body = f"SELECT {', '.join(out)} FROM z"
    rows = f"z AS (SELECT status, latency_ms, estimated_cost, total_tokens, feedback, {num('rating', 'feedback')} AS rating, json_extract_string(feedback, '$.task_success') AS done, {parsed} FROM r WHERE {within_sql()})"
    return with_log(body, rows)


@query("evaluation_analytics", _eval_sql())
def _evaluation(spark, folder):
    return E.evaluation_analytics(requests(spark, folder), START, END)


@query("eval_candidates", with_log("SELECT id, model FROM r WHERE status <> 'error' AND coalesce(json_extract_string(output_message, '$.content'), '') <> ''"))
def _candidates(spark, folder):
    return E.eval_candidates(requests(spark, folder)).select("id", "model")


@query("judge_inputs", with_log("""SELECT id, sys AS system_message, usr AS user_message, ans AS response, ctx AS context, exp AS expected,
  CASE WHEN ctx IS NOT NULL THEN '[Retrieved Context Documents]:' || chr(10) || ctx || chr(10) || chr(10) ELSE '' END || '[System Prompt Given to Assistant]:' || chr(10)
    || CASE WHEN sys = '' THEN '(none)' ELSE sys END || chr(10) || chr(10) || '[User Query]:' || chr(10) || usr || chr(10) || chr(10) || '[Assistant Response]:' || chr(10) || ans
    || CASE WHEN exp IS NOT NULL THEN chr(10) || chr(10) || '[Expected Ground Truth Answer]:' || chr(10) || exp ELSE '' END AS prompt
  FROM (SELECT r.id, CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[0].content') ELSE '' END AS sys,
    CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[1].content') ELSE json_extract_string(input_messages, '$[0].content') END AS usr,
    json_extract_string(output_message, '$.content') AS ans, coalesce(json_extract_string(metadata, '$.context'), g.context) AS ctx, json_extract_string(metadata, '$.expected_answer') AS exp
    FROM r LEFT JOIN g ON g.trace_id = r.trace_id WHERE status <> 'error' AND output_message IS NOT NULL) z""", TOOLS_SQL,
  "g AS (SELECT trace_id, string_agg(text, chr(10) || chr(10) ORDER BY created_at, id) AS context FROM o WHERE text IS NOT NULL GROUP BY trace_id)"))
def _judge_inputs(spark, folder):
    return E.judge_inputs(requests(spark, folder)).select("id", "system_message", "user_message", "response", "context", "expected", "prompt")


BY_REFERENCE_SQL = ("""j AS (SELECT r.id, r.trace_id, CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[0].content') ELSE '' END AS sys,
    CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[1].content') ELSE json_extract_string(input_messages, '$[0].content') END AS usr,
    json_extract_string(output_message, '$.content') AS ans, json_extract_string(metadata, '$.context') AS ctx, json_extract_string(metadata, '$.expected_answer') AS exp
    FROM r WHERE status <> 'error' AND output_message IS NOT NULL)""",
  """k AS (SELECT o.trace_id FROM o WHERE text IS NOT NULL GROUP BY o.trace_id HAVING count(*) > 1 OR max(length(text)) > 0)""")


@query("judge_prompt_parts", with_log("""SELECT j.id, CAST(0 AS INT) AS position, '[Retrieved Context Documents]:' || chr(10) AS text, j.trace_id AS context_of FROM j JOIN k ON k.trace_id = j.trace_id WHERE ctx IS NULL
  UNION ALL SELECT id, CAST(1 AS INT), CASE WHEN ctx IS NOT NULL THEN '[Retrieved Context Documents]:' || chr(10) || ctx || chr(10) || chr(10) ELSE '' END || '[System Prompt Given to Assistant]:' || chr(10)
    || CASE WHEN sys = '' THEN '(none)' ELSE sys END || chr(10) || chr(10) || '[User Query]:' || chr(10) || usr || chr(10) || chr(10) || '[Assistant Response]:' || chr(10) || ans
    || CASE WHEN exp IS NOT NULL THEN chr(10) || chr(10) || '[Expected Ground Truth Answer]:' || chr(10) || exp ELSE '' END, NULL FROM j""", TOOLS_SQL, *BY_REFERENCE_SQL))
def _prompt_parts(spark, folder):
    return E.judge_prompt_parts(requests(spark, folder))


@query("judge_context_slices", with_log("SELECT o.trace_id, o.id, o.text FROM o JOIN k ON k.trace_id = o.trace_id WHERE o.text IS NOT NULL", TOOLS_SQL, *BY_REFERENCE_SQL))
def _context_slices(spark, folder):
    return E.context_slices(requests(spark, folder)).select("trace_id", "id", "text")


# ---------------------------------------------------------------- alerts

ALERT_SQL = """SELECT id, model, upper(status) AS status, CAST(latency_ms AS VARCHAR) || ' ms' AS latency,
  CASE WHEN status = 'error' AND latency_ms >= 2000 THEN 'Request failed and exceeded latency threshold (' || CAST(latency_ms AS VARCHAR) || 'ms >= 2000ms).'
    WHEN status = 'error' THEN 'Request execution failed.' ELSE 'Request latency exceeded threshold (' || CAST(latency_ms AS VARCHAR) || 'ms >= 2000ms).' END AS reason,
  error_message AS error_details FROM r WHERE status = 'error' OR latency_ms >= 2000"""


@query("alerts", with_log(ALERT_SQL))
def _alerts(spark, folder):
    return alerts(requests(spark, folder), latency_ms=2000).select("id", "model", "status", "latency", "reason", "error_details")


@query("alert_payloads", with_log("""SELECT id, CASE WHEN status = 'error' THEN '#ff3333' ELSE '#ffaa00' END AS slack_colour,
  CAST(CASE WHEN status = 'error' THEN 16724787 ELSE 16755200 END AS INT) AS discord_colour, CAST(CASE WHEN error_message IS NULL THEN 5 ELSE 6 END AS INT) AS n_fields,
  CAST(floor(epoch(created_at)) AS BIGINT) AS ts FROM r WHERE status = 'error' OR latency_ms >= 2000"""))
def _payloads(spark, folder):
    rows = alerts(requests(spark, folder), latency_ms=2000)
    return rows.select("id", F.get_json_object("slack_payload", "$.attachments[0].color").alias("slack_colour"),
                       F.get_json_object("discord_payload", "$.embeds[0].color").cast("int").alias("discord_colour"),
                       F.json_array_length(F.get_json_object("discord_payload", "$.embeds[0].fields")).alias("n_fields"),
                       F.get_json_object("slack_payload", "$.attachments[0].ts").cast("long").alias("ts"))
