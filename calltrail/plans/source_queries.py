"""Ingestion, import, change tables and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import calls as S
from ..sources import changes as H
from ..sources import exports as X
from ..sources import imports as I
from ..sources import lookup as K
from ..sources import text_index as G
from ..sources.rewrites import apply_changes
from ..sources.tables import conform_requests, load_table, write_requests
from .registry import query, stamp, stamp_sql
from .report_queries import cents
from .views import CALLS, MODELS, models, requests, table, unpriced, view, with_log, with_view


def _events(spark, folder):
    return table(spark, folder, "events")


# ---------------------------------------------------------------- defaults

@query("conform_requests", f"""SELECT 'e' || CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'c' END AS conversation_id, 'deepinfra' AS provider,
  CASE WHEN event_type IN ('view', 'click') THEN 'success' ELSE event_type END AS status, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS latency_ms,
  CAST(0 AS BIGINT) AS total_tokens, CAST(0.0 AS DOUBLE) AS estimated_cost, '{{"k":' || json_extract_string(props, '$.k') || '}}' AS metadata, false AS stream, {stamp_sql('ts')} AS created_at FROM events""")
def _conform(spark, folder):
    raw = _events(spark, folder).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("c")).alias("conversation_id"),
        F.when(F.col("event_type") == "view", F.lit("")).when(F.col("event_type") != "click", F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.floor("value")).alias("latency_ms"),
        F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("metadata"), F.lit("m").alias("model"), F.col("ts").alias("created_at"))
    return conform_requests(raw).select("id", "conversation_id", "provider", "status", "latency_ms", "total_tokens", "estimated_cost", "metadata",
                                        "stream", stamp("created_at").alias("created_at"))


# ---------------------------------------------------------------- calls

def _calls(spark, folder):
    header = F.create_map(F.lit("X-User-Id"), F.col("user_header"), F.lit("x-span-type"), F.lit(""))
    return view(spark, folder, CALLS).select(
        "id", "request", "response", header.alias("headers"), F.col("http_status").cast("int").alias("http_status"), "latency_ms",
        "transport_error", F.lit(False).alias("stream"), "created_at")


# Token and cost rules: usage when given, else a quarter of the characters; failures count nothing.
CALLS_SQL = f"""c AS (SELECT v.*, json_extract_string(request, '$.model') AS m, response IS NULL AS broken,
    length(event_type || ' ' || CAST(k AS VARCHAR)) + 4 AS chars FROM v),
  t AS (SELECT *, CASE WHEN broken THEN 0 WHEN event_type = 'error' OR k % 2 = 1 THEN greatest(1, ceil(chars / 4.0)) ELSE 10 + k END AS pt,
    CASE WHEN broken THEN 0 WHEN event_type = 'error' THEN 1 WHEN k % 2 = 1 THEN greatest(1, ceil((6 + length(CAST(k AS VARCHAR))) / 4.0)) ELSE 5 + k END AS ct FROM c)"""


@query("normalize_calls", with_view(CALLS, f"""SELECT t.id, t.m AS model, CAST(pt AS BIGINT) AS prompt_tokens, CAST(ct AS BIGINT) AS completion_tokens, CAST(pt + ct AS BIGINT) AS total_tokens,
  CASE WHEN broken THEN 0.0 WHEN event_type <> 'error' AND k % 4 = 0 THEN 0.5 ELSE coalesce({cents('(pt / CAST(1000000 AS DOUBLE)) * p.input_cost_per_million + (ct / CAST(1000000 AS DOUBLE)) * p.output_cost_per_million', 6)}, 0.0) END AS estimated_cost,
  CASE WHEN broken OR event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN broken THEN 'socket hang up' WHEN event_type = 'error' THEN 'upstream ' || CAST(k AS VARCHAR) END AS error_message,
  coalesce(json_extract_string(request, '$.user'), user_header) AS user_id, json_extract_string(request, '$.trace_id') AS trace_id,
  CASE WHEN k % 5 = 0 THEN 'Deepinfra - ' || t.m END AS span_name, CASE WHEN k % 5 = 0 THEN 'llm' END AS span_type,
  CASE WHEN k % 4 = 0 THEN CAST(0.25 AS DOUBLE) END AS temperature, CASE WHEN k % 4 = 0 THEN CAST(64 AS BIGINT) END AS max_tokens,
  CASE WHEN NOT broken AND event_type <> 'error' THEN 'reply ' || CAST(k AS VARCHAR) END AS answer
  FROM t LEFT JOIN models p ON p.id = t.m""", CALLS_SQL, f"models AS ({MODELS})"))
def _normalize(spark, folder):
    rows = S.normalize_calls(_calls(spark, folder), models(spark))
    return rows.select("id", "model", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost", "status", "error_message", "user_id",
                       "trace_id", "span_name", "span_type", "temperature", "max_tokens", F.get_json_object("output_message", "$.content").alias("answer"))


@query("drop_blocked_calls", with_view(CALLS, "SELECT id, 'purchase' AS keyword FROM v WHERE event_type = 'purchase'"))
def _blocked(spark, folder):
    return S.drop_blocked(_calls(spark, folder), "Purchase, nothing")[1].select("id", "keyword")


def _chunks(spark, folder):
    """Every conversation text as a stream: words as deltas, a broken chunk, usage twice, the end mark."""
    talk = table(spark, folder, "conversations")
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id")
    words = talk.select(key, F.posexplode(F.split("text", "(?<= )")).alias("seq", "word"))

    def choice(*fields):
        return F.to_json(F.struct(F.array(F.struct(*fields)).alias("choices")))

    deltas = words.select("request_id", "seq", choice(F.struct(F.col("word").alias("content")).alias("delta")).alias("data"))

    def extra(seq, data):
        return talk.select(key, F.lit(seq).alias("seq"), data.alias("data"))

    def usage(n):
        return F.to_json(F.struct(F.struct(F.lit(n).cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens")).alias("usage")))

    return (deltas.unionByName(extra(-1, F.lit('{"choices":[{"delta":{"role":"assistant"}}]}'))).unionByName(extra(1_000_000, F.lit("{broken")))
            .unionByName(extra(1_000_001, usage(1))).unionByName(extra(1_000_002, usage(7)))
            .unionByName(extra(1_000_003, choice(F.struct().alias("delta"), F.lit("stop").alias("finish_reason"))))
            .unionByName(extra(1_000_004, F.lit("[DONE]"))))


@query("assemble_stream_chunks", """SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS request_id, text AS content, CAST(7 AS BIGINT) AS prompt_tokens,
  CAST(turn AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS total_tokens, 'stop' AS finish_reason FROM conversations""")
def _assemble(spark, folder):
    return S.assemble_stream_chunks(_chunks(spark, folder)).select("request_id", "content", "usage.*", "finish_reason")


# Every conversation text as a streamed call; some are refused.
@query("normalize_streamed_calls", """SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, CASE WHEN turn % 5 <> 4 THEN text END AS answer,
  CASE WHEN turn % 5 = 4 THEN CAST(0 AS BIGINT) ELSE 7 END AS prompt_tokens, CASE WHEN turn % 5 = 4 THEN CAST(0 AS BIGINT) ELSE CAST(turn AS BIGINT) END AS completion_tokens,
  CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'success' END AS status FROM conversations""")
def _normalize_streamed(spark, folder):
    talk = table(spark, folder, "conversations")
    calls = talk.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit('{"model":"m","messages":[{"role":"user","content":"hi"}]}').alias("request"),
        F.lit(None).cast("string").alias("response"), F.create_map(F.lit("x-user-id"), F.lit("u")).alias("headers"), F.when(F.col("turn") % 5 == 4, 500).otherwise(200).alias("http_status"),
        F.lit(3).cast("long").alias("latency_ms"), F.lit(None).cast("string").alias("transport_error"), F.lit(True).alias("stream"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    rows = S.normalize_calls(calls, models(spark), chunks=_chunks(spark, folder))
    return rows.select("id", F.get_json_object("output_message", "$.content").alias("answer"), "prompt_tokens", "completion_tokens", "status")


@query("redact_payloads", with_log("""SELECT id, '[{"role":"system","content":"[Payload logging disabled]"}]' AS input_messages,
  CASE WHEN output_message IS NOT NULL THEN '{"role":"assistant","content":"[Payload logging disabled]"}' END AS output_message,
  CASE WHEN raw_request IS NOT NULL THEN '{"info":"Payload logging disabled"}' END AS raw_request, total_tokens FROM r"""))
def _hide(spark, folder):
    return S.redact_payloads(requests(spark, folder), False).select("id", "input_messages", "output_message", "raw_request", "total_tokens")


# ---------------------------------------------------------------- import

# One record per event; every id that ends in 7 is used twice in a row of events, some lines are broken.
IMPORT_SQL = """i AS (SELECT event_id AS seq, event_type, CASE WHEN event_type = 'signup' THEN NULL ELSE 'imp_' || CAST(event_id - CASE WHEN event_id % 10 = 8 THEN 1 ELSE 0 END AS VARCHAR) END AS id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events),
  g AS (SELECT * FROM i WHERE event_type <> 'error' AND id IS NOT NULL),
  f AS (SELECT id, min(seq) AS seq FROM g GROUP BY id)"""


def _records(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    base = F.col("event_id") - F.when(F.col("event_id") % 10 == 8, F.lit(1)).otherwise(F.lit(0))
    ident = F.when(F.col("event_type") != "signup", F.concat(F.lit("imp_"), base.cast("string")))
    record = F.to_json(F.struct(
        ident.alias("id"), F.when(k % 2 == 0, F.lit("some/model")).alias("model"), F.lit('[{"role":"user","content":"hi"}]').alias("input_messages"),
        F.when(k % 3 == 0, F.lit("{oops")).otherwise(F.lit('{"role":"assistant","content":"yo"}')).alias("output_message"),
        k.alias("prompt_tokens"), (k + 1).cast("string").alias("completion_tokens"), F.when(k % 4 == 0, k * 10).alias("total_tokens"),
        (k / 4.0).alias("cost"), F.when(k % 5 == 0, F.array(F.lit("imported"), F.lit("old"))).otherwise(F.array(F.lit("old"))).alias("tags"),
        F.struct(k.alias("k")).alias("metadata"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at")))
    return _events(spark, folder).select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.lit('{"id": broken')).otherwise(record).alias("value"))


def _existing(spark, folder):
    return _events(spark, folder).filter("event_type = 'purchase'").select(F.concat(F.lit("imp_"), F.col("event_id").cast("string")).alias("id"))


@query("import_logs", f"""WITH {IMPORT_SQL} SELECT g.id, CASE WHEN k % 2 = 0 THEN 'some/model' ELSE 'unknown' END AS model, 'imported' AS provider,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'yo' END AS answer, k AS prompt_tokens, k + 1 AS completion_tokens, CASE WHEN k % 4 = 0 AND k > 0 THEN k * 10 ELSE k + k + 1 END AS total_tokens,
  k / 4.0 AS estimated_cost, CASE WHEN k % 5 = 0 THEN '["imported","old"]' ELSE '["old","imported"]' END AS tags, g.id AS span_id,
  'Imported - ' || CASE WHEN k % 2 = 0 THEN 'some/model' ELSE 'unknown' END AS span_name, '{{"k":' || CAST(k AS VARCHAR) || ',"imported":true}}' AS metadata,
  strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at
  FROM (SELECT coalesce(id, 'made up') AS id, id IS NULL AS made, seq, k, ts FROM i WHERE event_type <> 'error') g LEFT JOIN f ON f.id = g.id AND f.seq = g.seq
  WHERE made OR (f.id IS NOT NULL AND g.id NOT IN (SELECT 'imp_' || CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase'))""".replace("{{", "{").replace("}}", "}"))
def _import(spark, folder):
    rows, _ = I.import_records(_records(spark, folder), _existing(spark, folder))
    shown = [F.when(F.col(c).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit("made up")).otherwise(F.col(c)).alias(c) for c in ("id", "span_id")]
    return rows.select(shown[0], "model", "provider", F.get_json_object("output_message", "$.content").alias("answer"), "prompt_tokens", "completion_tokens",
                        "total_tokens", "estimated_cost", "tags", shown[1], "span_name", "metadata", stamp("created_at").alias("created_at"))


@query("import_rejects", f"""WITH {IMPORT_SQL} SELECT seq, 'not a JSON object' AS reason FROM i WHERE event_type = 'error'
  UNION ALL SELECT g.seq, 'duplicate id' FROM g JOIN f ON f.id = g.id WHERE g.seq <> f.seq
  UNION ALL SELECT g.seq, 'id exists' FROM g JOIN f ON f.id = g.id AND f.seq = g.seq WHERE g.id IN (SELECT 'imp_' || CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase')""")
def _import_rejects(spark, folder):
    return I.import_records(_records(spark, folder), _existing(spark, folder))[1].select("seq", "reason")


# ---------------------------------------------------------------- changes

# Changes: clicks set a status, views set tags twice, purchases clear the feedback, sign-ups delete,
# errors name unknown ids or give an empty status.
def _changes(spark, folder):
    e = _events(spark, folder)
    ident = F.concat(F.lit("req_"), F.col("event_id").cast("string"))

    def change(kind, field, value, shift=0, target=ident):
        return e.filter(F.col("event_type") == kind).select(
            target.alias("id"), F.lit(field).alias("field"), value.cast("string").alias("value"), (F.col("event_id") * 2 + shift).alias("seq"))

    return (change("click", "status", F.lit("reviewed")).unionByName(change("view", "tags", F.lit('["first"]')))
            .unionByName(change("view", "tags", F.lit('["second"]'), 1)).unionByName(change("purchase", "feedback", F.lit(None)))
            .unionByName(change("signup", "delete", F.lit(None))).unionByName(change("error", "status", F.lit("")))
            .unionByName(change("error", "status", F.lit("gone"), 1, F.concat(F.lit("nobody_"), F.col("event_id").cast("string")))))


@query("merge_changes", with_log("""SELECT r.id, CASE WHEN event_type = 'click' THEN 'reviewed' ELSE status END AS status,
  CASE WHEN event_type = 'view' THEN '["second"]' ELSE tags END AS tags, CASE WHEN event_type = 'purchase' THEN NULL ELSE feedback END AS feedback, evaluation
  FROM r JOIN events e ON r.id = 'req_' || CAST(e.event_id AS VARCHAR) WHERE event_type <> 'signup'"""))
def _merge(spark, folder):
    return H.merge_changes(unpriced(spark, folder), _changes(spark, folder))[0].select("id", "status", "tags", "feedback", "evaluation")


@query("apply_changes", with_log("""SELECT r.id, CASE WHEN event_type = 'click' THEN 'reviewed' ELSE status END AS status,
  CASE WHEN event_type = 'view' THEN '["second"]' ELSE tags END AS tags, CASE WHEN event_type = 'purchase' THEN NULL ELSE feedback END AS feedback, evaluation
  FROM r JOIN events e ON r.id = 'req_' || CAST(e.event_id AS VARCHAR) WHERE event_type <> 'signup'"""))
def _apply(spark, folder):
    store = scratch_path(spark, "changed")
    write_requests(unpriced(spark, folder), store)
    for _ in range(2):  # the second time nothing is left to do
        apply_changes(spark, store, _changes(spark, folder), "all")
    return load_table(spark, store).select("id", "status", "tags", "feedback", "evaluation")


def _indexed(spark, folder):
    """The log as a stored table, indexed in two batches."""
    store = scratch_path(spark, "indexed")
    log = unpriced(spark, folder)
    first = F.xxhash64("id") % 2 == 0
    for part in (log.filter(first), log.filter(~first)):
        write_requests(part, store)
        K.update_index(spark, store)
    return store


@query("lookup_traces_indexed", with_log("""SELECT id, trace_id, status FROM r WHERE trace_id IN (SELECT trace_id FROM r WHERE span_type = 'check' AND status = 'rejected' AND trace_id <> '')"""))
def _traces_indexed(spark, folder):
    keys = unpriced(spark, folder).filter("span_type = 'check' AND status = 'rejected'").select(F.col("trace_id").alias("key"))
    return K.rows_with(spark, _indexed(spark, folder), "trace_id", keys).select("id", "trace_id", "status")


@query("lookup_requests_indexed", with_log("""SELECT k.key, coalesce(a.id, b.id) AS id, coalesce(a.model, b.model) AS model
  FROM k LEFT JOIN r a ON a.id = k.key LEFT JOIN r b ON a.id IS NULL AND b.span_id = k.key WHERE coalesce(a.id, b.id) IS NOT NULL""",
  "k AS (SELECT CASE event_type WHEN 'click' THEN 'req_' WHEN 'view' THEN 'span_' ELSE 'none_' END || CAST(event_id AS VARCHAR) AS key FROM events)"))
def _requests_indexed(spark, folder):
    keys = view(spark, folder, "SELECT CASE event_type WHEN 'click' THEN 'req_' WHEN 'view' THEN 'span_' ELSE 'none_' END || CAST(event_id AS STRING) AS key FROM events")
    return K.find_requests(spark, _indexed(spark, folder), keys).select("key", "id", "model")


@query("search_requests_indexed", with_log("""SELECT id, status FROM r
  WHERE input_messages ILIKE '%USER1_@example%' OR output_message ILIKE '%USER1_@example%' OR model ILIKE '%USER1_@example%'"""))
def _search_indexed(spark, folder):
    store = scratch_path(spark, "searched")
    log = unpriced(spark, folder)
    first = F.xxhash64("id") % 2 == 0
    for part in (log.filter(first), log.filter(~first)):
        write_requests(part, store)
        G.update_text_index(spark, store)
    return G.search_stored(spark, store, "USER1_@example").select("id", "status")


@query("merge_change_rejects", """SELECT 'req_' || CAST(event_id AS VARCHAR) AS id, 'status is required' AS reason FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'nobody_' || CAST(event_id AS VARCHAR), 'unknown id' FROM events WHERE event_type = 'error'""")
def _merge_rejects(spark, folder):
    return H.merge_changes(unpriced(spark, folder), _changes(spark, folder))[1].select("id", "reason")


# Price changes come from the events: the latest valid one per model counts.
PRICE_SQL = """c AS (SELECT m.model AS id, CASE WHEN e.event_id % 3 <> 0 THEN e.value - 20 END AS lo, CASE WHEN e.event_id % 5 <> 0 THEN e.value END AS hi, e.event_id AS seq
    FROM events e JOIN r m ON m.id = 'req_' || CAST(e.event_id AS VARCHAR)),
  ok AS (SELECT * FROM c WHERE NOT (lo IS NULL AND hi IS NULL) AND coalesce(lo, 0) >= 0 AND coalesce(hi, 0) >= 0)"""


def _price_changes(spark, folder):
    e = _events(spark, folder).select(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("_req"), "event_id", "value")
    log = unpriced(spark, folder).select(F.col("id").alias("_req"), F.col("model").alias("id"))
    return e.join(log, "_req").select(
        "id", F.when(F.col("event_id") % 3 != 0, F.col("value") - 20).alias("input_cost_per_million"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("output_cost_per_million"), F.col("event_id").alias("seq"))


@query("merge_model_prices", with_log("""SELECT id, coalesce((SELECT arg_max(lo, seq) FROM ok WHERE ok.id = models.id AND lo IS NOT NULL), input_cost_per_million) AS input_cost_per_million,
  coalesce((SELECT arg_max(hi, seq) FROM ok WHERE ok.id = models.id AND hi IS NOT NULL), output_cost_per_million) AS output_cost_per_million FROM models""", PRICE_SQL))
def _prices(spark, folder):
    return H.merge_model_prices(models(spark), _price_changes(spark, folder))[0]


@query("merge_price_rejects", with_log("""SELECT id, seq, CASE WHEN lo IS NULL AND hi IS NULL THEN 'no price given' ELSE 'price must be non-negative' END AS reason FROM c
  WHERE (lo IS NULL AND hi IS NULL) OR coalesce(lo, 0) < 0 OR coalesce(hi, 0) < 0
  UNION ALL SELECT id, seq, 'unknown id' FROM ok WHERE id NOT IN (SELECT id FROM models)""", PRICE_SQL))
def _price_rejects(spark, folder):
    return H.merge_model_prices(models(spark), _price_changes(spark, folder))[1].select("id", "seq", "reason")


# Sources of the documents are registered as models: some bring a price, some a negative one, one is known.
@query("register_models", f"""WITH models AS ({MODELS}), n AS (SELECT DISTINCT source AS id, CASE WHEN source LIKE '%1' THEN -1.0 ELSE length(source) END AS price FROM documents)
  SELECT id, input_cost_per_million, output_cost_per_million FROM models UNION ALL SELECT id, CAST(price AS DOUBLE), CAST(0.0 AS DOUBLE) FROM n WHERE price >= 0""")
def _register(spark, folder):
    return H.register_models(models(spark), _new_models(spark, folder))[0].select("id", "input_cost_per_million", "output_cost_per_million")


@query("register_model_rejects", f"""WITH models AS ({MODELS}) SELECT DISTINCT source AS id, 'price must be non-negative' AS reason FROM documents WHERE source LIKE '%1'
  UNION ALL SELECT min(id), 'key exists' FROM models""")
def _register_rejects(spark, folder):
    return H.register_models(models(spark), _new_models(spark, folder))[1].select("id", "reason")


def _new_models(spark, folder):
    named = table(spark, folder, "documents").select("source").distinct()
    price = F.when(F.col("source").endswith("1"), F.lit(-1.0)).otherwise(F.length("source").cast("double"))
    known = models(spark).agg(F.min("id").alias("id")).select("id", F.lit(1.0).alias("input_cost_per_million"))
    return named.select(F.col("source").alias("id"), price.alias("input_cost_per_million")).unionAll(known)


@query("insert_if_absent", with_log("""SELECT id, origin FROM (SELECT id, origin, row_number() OVER (PARTITION BY id ORDER BY rank, seq) AS rn FROM (
    SELECT DISTINCT conversation_id AS id, 'old' AS origin, 0 AS rank, 0 AS seq FROM r WHERE conversation_id IS NOT NULL
    UNION ALL SELECT 'conv_' || CAST(user_id AS VARCHAR) || '_1', 'new ' || CAST(event_id AS VARCHAR), 1, event_id FROM events) z) y WHERE rn = 1"""))
def _insert(spark, folder):
    base = unpriced(spark, folder).filter(F.col("conversation_id").isNotNull()).select(F.col("conversation_id").alias("id"), F.lit("old").alias("origin")).distinct()
    new = _events(spark, folder).select(F.concat(F.lit("conv_"), F.col("user_id").cast("string"), F.lit("_1")).alias("id"),
                                        F.concat(F.lit("new "), F.col("event_id").cast("string")).alias("origin"), F.col("event_id").alias("seq"))
    return H.insert_if_absent(base, new, "id", "seq")[0].select("id", "origin")


# ---------------------------------------------------------------- exports

def _quoted(c):
    return f"""CASE WHEN {c} IS NULL THEN '' WHEN contains({c}, ',') OR contains({c}, '"') OR contains({c}, chr(10)) THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


CSV_SQL = "SELECT id, id || ',' || model || ',' || provider || ',' || status || ',' || CAST(prompt_tokens AS VARCHAR) || ',' || CAST(completion_tokens AS VARCHAR) || ',' || " \
    "CAST(total_tokens AS VARCHAR) || ',' || CASE WHEN estimated_cost = 0 THEN '0' ELSE rtrim(CAST(CAST(estimated_cost AS DECIMAL(18, 8)) AS VARCHAR), '0') END || ',' || " \
    "CAST(latency_ms AS VARCHAR) || ',' || CASE WHEN temperature IS NULL THEN '' ELSE '0.5' END || ',' || coalesce(CAST(max_tokens AS VARCHAR), '') || ',' || coalesce(user_id, '') || ',' || " \
    "CASE WHEN stream THEN '1' ELSE '0' END || ',' || " + _quoted("error_message") + " || ',' || " + _quoted("tags") + " || ',' || " + _quoted("feedback") + " || ',' || " + _quoted("evaluation") + \
    " || ',' || strftime(date_trunc('millisecond', created_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS line FROM r"


# Both exporters write files; the queries read them back.
@query("export_csv", with_log(CSV_SQL))
def _csv(spark, folder):
    path = scratch_path(spark, "csv")
    X.export_csv(requests(spark, folder), path)
    return spark.read.text(f"{path}/rows").select(F.substring_index("value", ",", 1).alias("id"), F.col("value").alias("line"))


@query("export_finetuning", with_log("""SELECT '{"messages":' || left(input_messages, length(input_messages) - 1) || ',' || output_message || ']}' AS line
  FROM r WHERE status = 'success' AND output_message IS NOT NULL"""))
def _finetuning(spark, folder):
    path = scratch_path(spark, "finetuning")
    X.export_finetuning(requests(spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
