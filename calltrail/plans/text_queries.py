"""Masking, guardrails, text and retrieval metrics, prompts and judge output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import pii
from ..functions import text as X
from ..functions.base import js_round
from ..functions.retrieval import mrr, precision_at_k, recall_at_k
from ..operators import evaluation as E
from ..operators import metrics as K
from ..operators import prompts as P
from .registry import query
from .report_queries import cents
from .views import JUDGED, PROMPTS, RETRIEVAL, TEXT_PAIRS, table, unpriced, view, with_log, with_view


def _documents(spark, folder):
    return table(spark, folder, "documents")


def _one_message(text="text"):
    return F.array(F.struct(F.lit("user").alias("role"), F.col(text).alias("content")))


# ---------------------------------------------------------------- masking and guardrails

MASK_SQL = r"""regexp_replace(regexp_replace(regexp_replace({c}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', '[EMAIL_REDACTED]', 'g'),
  '\b(?:\d[ -]*?){{13,19}}\b', '[CARD_REDACTED]', 'g'), '\b(?:\+\d{{1,3}}[-.\s]?)?\(?\d{{2,4}}\)?[-.\s]?\d{{2,4}}[-.\s]?\d{{4}}\b', '[PHONE_REDACTED]', 'g')"""


@query("mask_pii", f"SELECT doc_id, {MASK_SQL.format(c='text')} AS masked FROM documents")
def _mask(spark, folder):
    return _documents(spark, folder).select("doc_id", pii.mask_pii("text").alias("masked"))


@query("mask_pii_html", f"SELECT page_id, {MASK_SQL.format(c='html')} AS masked FROM pages")
def _mask_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", pii.mask_pii("html").alias("masked"))


@query("mask_pii_json", f"SELECT doc_id, {MASK_SQL.format(c='text')} AS masked, source FROM documents")
def _mask_json(spark, folder):
    doc = F.to_json(F.struct(F.struct(F.col("text").alias("body")).alias("inner"), F.array("text").alias("list"), F.col("source").alias("source")))
    masked = _documents(spark, folder).select("doc_id", pii.mask_pii_json(doc).alias("d"))
    return masked.select("doc_id", F.get_json_object("d", "$.list[0]").alias("masked"), F.get_json_object("d", "$.source").alias("source"))


@query("redact_messages", f"SELECT conv_id, turn, {MASK_SQL.format(c='text')} AS content FROM conversations")
def _redact(spark, folder):
    rows = table(spark, folder, "conversations")
    messages = F.array(F.struct("role", F.col("text").alias("content")))
    return rows.select("conv_id", "turn", F.get(pii.redact_messages(messages), F.lit(0))["content"].alias("content"))


def _first_hit(words):
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in words) + " END"


@query("guardrail_check_default", f"SELECT doc_id, k IS NOT NULL AS blocked, k AS keyword FROM (SELECT doc_id, {_first_hit(pii.banned_list())} AS k FROM documents) z")
def _guard(spark, folder):
    check = pii.guardrail_check(_one_message())
    return _documents(spark, folder).select("doc_id", check.alias("c")).select("doc_id", "c.blocked", "c.keyword")


@query("guardrail_check", f"SELECT doc_id, k IS NOT NULL AS blocked, k AS keyword FROM (SELECT doc_id, {_first_hit(['licence', 'license', 'http', 'der'])} AS k FROM documents) z")
def _guard_words(spark, folder):
    check = pii.guardrail_check(_one_message(), "Licence, license ,HTTP,der")
    return _documents(spark, folder).select("doc_id", check.alias("c")).select("doc_id", "c.blocked", "c.keyword")


@query("classify_task_keywords", """SELECT doc_id, CASE WHEN contains(t, 'summarize') OR contains(t, 'summary') THEN 'summarization'
  WHEN contains(t, 'paraphrase') OR contains(t, 'rephrase') OR contains(t, 'reword') OR contains(t, 'rewrite') THEN 'paraphrase'
  WHEN contains(t, 'code') OR contains(t, 'function') OR contains(t, 'javascript') OR contains(t, 'python') THEN 'code_generation' ELSE 'general' END AS task_type
  FROM (SELECT doc_id, lower(text) AS t FROM documents) z""")
def _task(spark, folder):
    return _documents(spark, folder).select("doc_id", M.classify_task_keywords("text").alias("task_type"))


# ---------------------------------------------------------------- scalar rules

@query("js_round", f"SELECT event_id, {cents('value - 250', 1)} AS rounded, floor((value - 250) + 0.5) AS whole FROM events")
def _round(spark, folder):
    events = table(spark, folder, "events")
    x = F.col("value") - 250
    return events.select("event_id", js_round(x, 1).alias("rounded"), js_round(x).cast("double").alias("whole"))


@query("mask_secret", """SELECT doc_id, CASE WHEN source = '' THEN '' WHEN length(s) > 8 THEN substr(s, 1, 4) || '...' || right(s, 4) ELSE '********' END AS shown
  FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '-' || lang || '-' || CAST(doc_id AS VARCHAR) END AS s FROM documents) z""")
def _secret(spark, folder):
    s = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string")))
    return _documents(spark, folder).select("doc_id", M.mask_secret(s).alias("shown"))


@query("parse_created_at", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS plain, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS iso FROM events")
def _parse_time(spark, folder):
    events = table(spark, folder, "events")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select("event_id", F.date_format(M.parse_created_at(plain), "yyyy-MM-dd HH:mm:ss").alias("plain"),
                         F.date_format(M.parse_created_at(iso), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("iso"))


@query("derive_feedback", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1 WHEN r >= 4 THEN 1 WHEN r <= 2 THEN -1 END AS INT) AS score, CAST(r AS DOUBLE) AS rating,
  CASE WHEN event_type = 'view' THEN 'nice' ELSE '' END AS comment FROM (SELECT event_id, event_type, 1 + CAST(json_extract_string(props, '$.k') AS INT) % 5 AS r FROM events) z""")
def _derive(spark, folder):
    events = table(spark, folder, "events")
    rating = F.lit(1) + F.get_json_object("props", "$.k").cast("int") % 5
    score = F.when(F.col("event_id") % 4 == 0, F.lit(1))
    comment = F.when(F.col("event_type") == "view", F.lit("nice"))
    fb = M.derive_feedback(score, rating, comment, F.lit(None), F.lit(None))
    return events.select("event_id", fb.alias("f")).select("event_id", "f.score", "f.rating", "f.comment")


@query("estimate_tokens", """SELECT conv_id, turn, CAST(greatest(1, ceil((length(text) + length(role)) / 4.0)) AS BIGINT) AS prompt_tokens,
  CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS completion_tokens FROM conversations""")
def _estimate(spark, folder):
    rows = table(spark, folder, "conversations")
    est = M.estimate_tokens(F.array(F.struct("role", F.col("text").alias("content"))), "text")
    return rows.select("conv_id", "turn", est.alias("e")).select("conv_id", "turn", "e.prompt_tokens", "e.completion_tokens")


@query("canonical_messages", with_log("""SELECT id, CAST(CASE WHEN inp IS NULL THEN 0 ELSE json_array_length(inp) END AS INT) AS n_inputs,
  json_extract_string(inp, '$[0].role') AS first_role, json_extract_string(inp, '$[0].content') AS first_content, json_extract_string(outp, '$.content') AS answer
  FROM (SELECT id, CASE WHEN user_id IS NULL THEN json_extract(raw_request, '$.messages') ELSE input_messages END AS inp,
    coalesce(output_message, json_extract(raw_response, '$.choices[0].message')) AS outp FROM r) z"""))
def _canonical(spark, folder):
    rows = unpriced(spark, folder)
    stored = F.when(F.col("user_id").isNotNull(), F.col("input_messages"))
    both = rows.select("id", M.canonical_inputs(stored, "raw_request").alias("i"), M.canonical_output("output_message", "raw_response").alias("o"))
    first = F.get("i", F.lit(0))
    return both.select("id", F.size("i").alias("n_inputs"), first["role"].alias("first_role"), first["content"].alias("first_content"), F.col("o.content").alias("answer"))


@query("last_user_message", with_log("""SELECT id, CASE WHEN json_array_length(input_messages) = 2 THEN json_extract_string(input_messages, '$[1].content')
  ELSE json_extract_string(input_messages, '$[0].content') END AS content FROM r"""))
def _last_user(spark, folder):
    last = M.last_user_message(M.parse_messages("input_messages"))
    return unpriced(spark, folder).select("id", last["content"].alias("content"))


# ---------------------------------------------------------------- text metrics

def norm_sql(c):
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[.,/#!$%^&*;:{{}}=\-_`~()?"]', '', 'g'), '\b(a|an|the)\b', '', 'g'), '\s+', ' ', 'g'))"""


def _toks_sql(c):
    return f"[w FOR w IN string_split({norm_sql(c)}, ' ') IF w <> '']"


TOKENS_SQL = f"p AS (SELECT conv_id, turn, {_toks_sql('generated')} AS g, {_toks_sql('expected')} AS e FROM v)"


def _overlap_ctes(n):
    """CTE o<n>: clipped n-gram overlap per pair."""
    def side(col):
        grams = f"[array_to_string({col}[i:i + {n - 1}], ' ') FOR i IN range(1, len({col}) - {n - 2})]"
        return f"(SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest({grams}) AS t FROM p) u GROUP BY ALL)"
    return (f"o{n} AS (SELECT x.conv_id, x.turn, CAST(sum(least(x.c, y.c)) AS DOUBLE) AS o FROM {side('g')} x "
            f"JOIN {side('e')} y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.t = y.t GROUP BY x.conv_id, x.turn)")


def _pairs_view(spark, folder):
    return view(spark, folder, TEXT_PAIRS)


KEY = ["conv_id", "turn"]


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def _normal(spark, folder):
    return _documents(spark, folder).select("doc_id", X.normalize_text("text").alias("normal"))


@query("exact_match", with_view(TEXT_PAIRS, f"SELECT conv_id, turn, CAST({norm_sql('generated')} = {norm_sql('expected')} AS INT) AS exact_match FROM v"))
def _exact(spark, folder):
    return _pairs_view(spark, folder).select(*KEY, X.exact_match("generated", "expected").alias("exact_match"))


@query("token_f1", with_view(TEXT_PAIRS, """SELECT p.conv_id, p.turn, coalesce(CASE WHEN o > 0 THEN round((2.0 * (o / len(g)) * (o / len(e))) / (o / len(g) + o / len(e)), 9) END, 0.0) AS f1_score
  FROM p LEFT JOIN o1 ON o1.conv_id = p.conv_id AND o1.turn = p.turn""", TOKENS_SQL, _overlap_ctes(1)))
def _f1(spark, folder):
    return K.token_f1(_pairs_view(spark, folder), KEY).withColumn("f1_score", F.round("f1_score", 9))


def _rouge_sql(n):
    return with_view(TEXT_PAIRS, f"SELECT p.conv_id, p.turn, coalesce(round(o / (len(e) - {n - 1}), 9), 0.0) AS rouge_{n} FROM p LEFT JOIN o{n} o ON o.conv_id = p.conv_id AND o.turn = p.turn", TOKENS_SQL, _overlap_ctes(n))


@query("rouge_1", _rouge_sql(1))
def _rouge1(spark, folder):
    return K.rouge_n(_pairs_view(spark, folder), KEY, 1).withColumn("rouge_1", F.round("rouge_1", 9))


@query("rouge_2", _rouge_sql(2))
def _rouge2(spark, folder):
    return K.rouge_n(_pairs_view(spark, folder), KEY, 2).withColumn("rouge_2", F.round("rouge_2", 9))


def _lcs_cte(source, keys, a, b):
    """CTE l: length of the longest common subsequence of two lists, one table row per step."""
    step = f"CASE WHEN {b}[k] = {a}[i + 1] THEN coalesce(CASE WHEN k > 1 THEN line[k - 1] END, 0) + 1 ELSE 0 END"
    return (f"s AS (SELECT {keys}, {a}, {b}, 0 AS i, [0 FOR x IN {b}] AS line FROM {source} UNION ALL SELECT {keys}, {a}, {b}, i + 1, "
            f"[greatest(line[j], list_max([{step} FOR k IN range(1, j + 1)])) FOR j IN range(1, len({b}) + 1)] FROM s WHERE i < len({a})), "
            f"l AS (SELECT {keys}, len({b}) AS n, coalesce(line[len({b})], 0) AS lcs FROM s WHERE i = len({a}))")


@query("rouge_l", with_view(TEXT_PAIRS, "SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0 ELSE round(lcs / CAST(n AS DOUBLE), 9) END AS rouge_l FROM l",
                            TOKENS_SQL, _lcs_cte("p", "conv_id, turn", "g", "e")).replace("WITH ", "WITH RECURSIVE ", 1))
def _rouge_l(spark, folder):
    return K.rouge_l(_pairs_view(spark, folder), KEY).withColumn("rouge_l", F.round("rouge_l", 9))


def _bleu_sql():
    logs = " + ".join(f"CASE WHEN o{n}.o > 0 THEN 0.25 * ln(o{n}.o / (len(g) - {n - 1})) ELSE 0.0 END" for n in range(1, 5))
    hits = " + ".join(f"CASE WHEN o{n}.o > 0 THEN 1 ELSE 0 END" for n in range(1, 5))
    joins = " ".join(f"LEFT JOIN o{n} ON o{n}.conv_id = p.conv_id AND o{n}.turn = p.turn" for n in range(1, 5))
    return with_view(TEXT_PAIRS, f"""SELECT conv_id, turn, CASE WHEN hits = 0 THEN 0.0 ELSE round(CASE WHEN ng > ne THEN 1.0 ELSE exp(1.0 - ne / CAST(ng AS DOUBLE)) END * exp(logs), 9) END AS bleu
      FROM (SELECT p.conv_id, p.turn, len(g) AS ng, len(e) AS ne, {logs} AS logs, {hits} AS hits FROM p {joins}) z""", TOKENS_SQL, *[_overlap_ctes(n) for n in range(1, 5)])


@query("bleu4", _bleu_sql())
def _bleu(spark, folder):
    return K.bleu4(_pairs_view(spark, folder), KEY).withColumn("bleu", F.round("bleu", 9))


METRICS_SQL = f"""SELECT p.conv_id, p.turn, CAST({norm_sql('v.generated')} = {norm_sql('v.expected')} AS INT) AS exact_match,
  coalesce(CASE WHEN o1.o > 0 THEN round((2.0 * (o1.o / len(g)) * (o1.o / len(e))) / (o1.o / len(g) + o1.o / len(e)), 9) END, 0.0) AS f1_score,
  coalesce(round(o1.o / len(e), 9), 0.0) AS rouge_1, coalesce(round(o2.o / (len(e) - 1), 9), 0.0) AS rouge_2
  FROM p JOIN v ON v.conv_id = p.conv_id AND v.turn = p.turn LEFT JOIN o1 ON o1.conv_id = p.conv_id AND o1.turn = p.turn
  LEFT JOIN o2 ON o2.conv_id = p.conv_id AND o2.turn = p.turn WHERE v.expected <> ''"""


@query("text_metrics", with_view(TEXT_PAIRS, METRICS_SQL, TOKENS_SQL, _overlap_ctes(1), _overlap_ctes(2)))
def _all_metrics(spark, folder):
    rows = K.text_metrics(_pairs_view(spark, folder), KEY)
    return rows.select(*KEY, "exact_match", *[F.round(c, 9).alias(c) for c in ("f1_score", "rouge_1", "rouge_2")])


# ---------------------------------------------------------------- retrieval metrics

def _hits(cut):
    return f"len([x FOR x IN {cut} IF list_contains(relevant_ids, x)])"


@query("retrieval_metrics", with_view(RETRIEVAL, f"""SELECT l_orderkey, l_linenumber, l_partkey, round({_hits('retrieved_ids')} / CAST(2 AS DOUBLE), 9) AS recall,
  round({_hits('retrieved_ids[1:3]')} / CAST(2 AS DOUBLE), 9) AS recall_at_3, round({_hits('retrieved_ids')} / CAST(5 AS DOUBLE), 9) AS "precision",
  round({_hits('retrieved_ids[1:3]')} / CAST(3 AS DOUBLE), 9) AS precision_at_3,
  coalesce(round(1.0 / list_min([i FOR i IN range(1, 6) IF list_contains(relevant_ids, retrieved_ids[i])]), 9), 0.0) AS mrr FROM v"""))
def _retrieval(spark, folder):
    rows = view(spark, folder, RETRIEVAL)
    got, want = "retrieved_ids", "relevant_ids"
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(recall_at_k(got, want), 9).alias("recall"),
                       F.round(recall_at_k(got, want, 3), 9).alias("recall_at_3"), F.round(precision_at_k(got, want), 9).alias("precision"),
                       F.round(precision_at_k(got, want, 3), 9).alias("precision_at_3"), F.round(mrr(got, want), 9).alias("mrr"))


# ---------------------------------------------------------------- prompts

@query("latest_prompts", with_view(PROMPTS, "SELECT name, max(version) AS version, arg_max(user_template, version) AS user_template FROM v GROUP BY name"))
def _latest(spark, folder):
    return P.latest_prompts(view(spark, folder, PROMPTS)).select("name", "version", "user_template")


@query("prompt_history", with_view(PROMPTS, "SELECT name, version, system_prompt FROM v"))
def _history(spark, folder):
    return P.prompt_history(view(spark, folder, PROMPTS)).select("name", "version", "system_prompt")


NEW_SQL = """n AS (SELECT doc_id AS seq, CASE WHEN toxic = 1 THEN 'bad/name' ELSE 'src' || CAST(doc_id % 30 AS VARCHAR) END AS name FROM labels)"""


def _new_prompts(spark, folder):
    labels = table(spark, folder, "labels")
    name = F.when(F.col("toxic") == 1, F.lit("bad/name")).otherwise(F.concat(F.lit(" src"), (F.col("doc_id") % 30).cast("string")))
    return labels.select(F.col("doc_id").alias("seq"), name.alias("name"), F.lit("be brief").alias("system_prompt"),
                         F.lit("{{x}}").alias("user_template"), F.array(F.lit("x")).alias("variables"))


@query("append_prompt_versions", with_view(PROMPTS, """SELECT name, version FROM v UNION ALL SELECT n.name, coalesce(m.top, 0) + row_number() OVER (PARTITION BY n.name ORDER BY seq) AS version
  FROM n LEFT JOIN (SELECT name, max(version) AS top FROM v GROUP BY name) m ON m.name = n.name WHERE n.name <> 'bad/name'""", NEW_SQL))
def _append(spark, folder):
    return P.append_prompt_versions(view(spark, folder, PROMPTS), _new_prompts(spark, folder))[0].select("name", "version")


@query("append_prompt_rejects", f"WITH {NEW_SQL} SELECT seq, name FROM n WHERE name = 'bad/name'")
def _append_rejects(spark, folder):
    return P.append_prompt_versions(view(spark, folder, PROMPTS), _new_prompts(spark, folder))[1].select("seq", "name")


@query("prompt_diff_pairs", with_view(PROMPTS, """SELECT name, from_version, to_version FROM (SELECT name, version AS to_version,
  lag(version) OVER (PARTITION BY name ORDER BY version) AS from_version FROM v) z WHERE from_version IS NOT NULL"""))
def _diff_pairs(spark, folder):
    return P.prompt_diff(view(spark, folder, PROMPTS)).select("name", "from_version", "to_version").distinct()


# Undoing a diff must give back both texts: unchanged and removed lines are the old one, unchanged and added ones the new one.
# Their number of unchanged lines must be that of the longest common subsequence.
STEPS_SQL = """d AS (SELECT name, to_version, string_split(old, chr(10)) AS a, string_split(new, chr(10)) AS b
  FROM (SELECT name, version AS to_version, user_template AS new, lag(user_template) OVER (PARTITION BY name ORDER BY version) AS old FROM v) z WHERE old IS NOT NULL)"""


@query("prompt_diff_texts", with_view(PROMPTS, "SELECT name, to_version, array_to_string(a, chr(10)) AS old_text, array_to_string(b, chr(10)) AS new_text FROM d", STEPS_SQL))
def _diff_texts(spark, folder):
    edits = P.prompt_diff(view(spark, folder, PROMPTS))

    def side(left_out):
        lines = F.array_sort(F.collect_list(F.when(F.col("type") != left_out, F.struct("line_no", "text"))))
        return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")

    return edits.groupBy("name", "to_version").agg(side("added").alias("old_text"), side("removed").alias("new_text"))


@query("prompt_diff_unchanged", with_view(PROMPTS, "SELECT name, to_version, CAST(lcs AS BIGINT) AS unchanged FROM l", STEPS_SQL,
                                          _lcs_cte("d", "name, to_version", "a", "b")).replace("WITH ", "WITH RECURSIVE ", 1))
def _diff_unchanged(spark, folder):
    edits = P.prompt_diff(view(spark, folder, PROMPTS))
    return edits.groupBy("name", "to_version").agg(F.count_if(F.col("type") == "unchanged").alias("unchanged"))


@query("prompt_diff_sides", with_view(PROMPTS, """SELECT name, to_version, CAST(len(string_split(old, chr(10))) AS BIGINT) AS old_lines, CAST(len(string_split(new, chr(10))) AS BIGINT) AS new_lines
  FROM (SELECT name, version AS to_version, user_template AS new, lag(user_template) OVER (PARTITION BY name ORDER BY version) AS old FROM v) z WHERE old IS NOT NULL"""))
def _diff_sides(spark, folder):
    edits = P.prompt_diff(view(spark, folder, PROMPTS))
    return edits.groupBy("name", "to_version").agg(F.count_if(F.col("type") != "added").alias("old_lines"), F.count_if(F.col("type") != "removed").alias("new_lines"))


# The walk back through the whole table of common subsequences, from the ends of both texts; on equal choices an addition.
WALK_SQL = """w AS (SELECT name, from_version, to_version, a, b, len(a) AS i, len(b) AS j, 0 AS k, '' AS kind, '' AS line FROM d
  UNION ALL SELECT name, from_version, to_version, a, b, CASE WHEN kind <> 'added' THEN i - 1 ELSE i END, CASE WHEN kind <> 'removed' THEN j - 1 ELSE j END, k + 1, kind, CASE WHEN kind = 'added' THEN b[j] ELSE a[i] END
  FROM (SELECT w.name, w.from_version, w.to_version, w.a, w.b, w.i, w.j, w.k, CASE WHEN w.i > 0 AND w.j > 0 AND w.a[w.i] = w.b[w.j] THEN 'unchanged'
      WHEN w.j > 0 AND (w.i = 0 OR coalesce(CASE WHEN w.j > 1 THEN here.line[w.j - 1] END, 0) >= up.line[w.j]) THEN 'added' ELSE 'removed' END AS kind
    FROM w JOIN s here ON here.name = w.name AND here.to_version = w.to_version AND here.i = w.i
      LEFT JOIN s up ON up.name = w.name AND up.to_version = w.to_version AND up.i = w.i - 1 WHERE w.i > 0 OR w.j > 0) x)"""


@query("prompt_diff", with_view(PROMPTS, """SELECT name, from_version, to_version, CAST(row_number() OVER (PARTITION BY name, to_version ORDER BY k DESC) - 1 AS INT) AS line_no, kind AS type, line AS text
  FROM w WHERE k > 0""", STEPS_SQL.replace("SELECT name, to_version, string_split(old", "SELECT name, from_version, to_version, string_split(old").replace("SELECT name, version AS to_version,", "SELECT name, version AS to_version, lag(version) OVER (PARTITION BY name ORDER BY version) AS from_version,"),
                                _lcs_cte("d", "name, to_version", "a", "b"), WALK_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def _diff(spark, folder):
    return P.prompt_diff(view(spark, folder, PROMPTS))


@query("template_variables", with_view(PROMPTS, "SELECT name, version, array_to_string(['title', 'user'], ',') AS variables FROM v"))
def _variables(spark, folder):
    return view(spark, folder, PROMPTS).select("name", "version", F.array_join(M.template_variables("user_template"), ",").alias("variables"))


@query("render_prompts", with_view(PROMPTS, """SELECT b.binding_id, v.name, v.version, v.system_prompt, replace(replace(v.user_template, '{{ title }}', b.title), '{{user}}', '{{user}}') AS user_prompt
  FROM (SELECT doc_id AS binding_id, source AS name, '{{user}} of ' || lang AS title FROM documents) b JOIN v ON v.name = b.name AND v.version = b.binding_id + 1"""))
def _render(spark, folder):
    docs = _documents(spark, folder)
    title = F.concat(F.lit("{{user}} of "), F.col("lang"))
    bindings = docs.select(F.col("doc_id").alias("binding_id"), F.col("source").alias("name"), (F.col("doc_id") + 1).alias("version"),
                           F.create_map(F.lit("title"), title).alias("values"))
    return P.render_prompts(view(spark, folder, PROMPTS), bindings)


# ---------------------------------------------------------------- judge output

JUDGE_OUT = """SELECT id, CAST(s AS DOUBLE) AS score, CASE WHEN c BETWEEN 1 AND 5 THEN floor(c * 10.0 + 0.5) / CAST(10.0 AS DOUBLE) END AS coherence, CAST(4.0 AS DOUBLE) AS fluency,
  CASE WHEN right(id, 1) IN ('0', '2', '4') THEN CAST(3.1 AS DOUBLE) END AS faithfulness, CASE WHEN c BETWEEN 1 AND 5 THEN 'coherence,fluency' ELSE 'fluency' END AS task_metrics, st AS safety_status
  FROM (SELECT id, CAST(json_extract_string(judge_json, '$.score') AS DOUBLE) AS s, CAST(json_extract_string(judge_json, '$.coherence') AS DOUBLE) AS c,
    json_extract_string(judge_json, '$.safety_status') AS st FROM v) z WHERE s BETWEEN 1 AND 5"""


@query("assemble_evaluation", with_view(JUDGED, JUDGE_OUT))
def _assemble(spark, folder):
    judged = view(spark, folder, JUDGED)
    candidates = judged.select("id", F.when(F.right("id", F.lit(1)).isin("0", "2", "4"), F.lit("a page")).alias("context"))
    done, _ = E.assemble_evaluation(judged, candidates)
    return done.select("id", "score", "coherence", "fluency", "faithfulness", F.array_join("task_metrics", ",").alias("task_metrics"), F.col("safety.status").alias("safety_status"))


# Judge rows of the text pairs, with ids found for them: scores 0 and 6 are no scores, a third is not called aligned.
PAIR_ID, PAIR_SCORE, PAIR_ALIGNED = "CAST(conv_id AS {S}) || '-' || CAST(turn AS {S})", "(conv_id + turn) % 7", "conv_id % 3 <> 0"
FOUND, RELEVANT = ("conv_id % 5", "turn % 5", "(conv_id + turn) % 5"), ("conv_id % 4", "turn % 3")


@query("assemble_evaluation_metrics", with_view(TEXT_PAIRS, f"""SELECT id, CASE WHEN judged THEN CAST(s AS DOUBLE) ELSE 0.0 END AS score,
  CASE WHEN aligned OR NOT judged THEN exact_match END AS exact_match, CASE WHEN aligned OR NOT judged THEN f1_score END AS f1_score,
  CASE WHEN aligned OR NOT judged THEN rouge_1 END AS rouge_1, CASE WHEN aligned OR NOT judged THEN rouge_2 END AS rouge_2,
  round({_hits('found')} / CAST(2 AS DOUBLE), 9) AS recall_at_k, round({_hits('found')} / CAST(3 AS DOUBLE), 9) AS precision_at_k,
  coalesce(round(1.0 / list_min([i FOR i IN range(1, 4) IF list_contains(relevant_ids, found[i])]), 9), 0.0) AS mrr
  FROM (SELECT {PAIR_ID.format(S='VARCHAR')} AS id, {PAIR_SCORE} AS s, {PAIR_SCORE} BETWEEN 1 AND 5 AS judged, {PAIR_ALIGNED} AS aligned, [{', '.join(FOUND)}] AS found, [{', '.join(RELEVANT)}] AS relevant_ids,
    m.* EXCLUDE (conv_id, turn) FROM v LEFT JOIN m USING (conv_id, turn)) z""", TOKENS_SQL, _overlap_ctes(1), _overlap_ctes(2), f"m AS ({METRICS_SQL})"))
def _assemble_metrics(spark, folder):
    pairs = _pairs_view(spark, folder).withColumn("id", F.expr(PAIR_ID.format(S="STRING")))
    fit = F.expr(f"IF({PAIR_ALIGNED}, '\"ground_truth_alignment\"', '')")
    parsed = pairs.select("id", F.concat(F.lit('{"score":'), F.expr(PAIR_SCORE).cast("string"), F.lit(',"applicable_metrics":['), fit, F.lit("]}")).alias("judge_json"))
    found, relevant = F.array(*map(F.expr, FOUND)), F.array(*map(F.expr, RELEVANT))
    places = pairs.select("id", recall_at_k(found, relevant).alias("recall_at_k"), precision_at_k(found, relevant).alias("precision_at_k"), mrr(found, relevant).alias("mrr"))
    metrics = places.join(K.text_metrics(pairs, "id"), "id", "left")
    done, rejects = E.assemble_evaluation(parsed, metrics=metrics)
    names = ("f1_score", "rouge_1", "rouge_2", "recall_at_k", "precision_at_k", "mrr")
    both = done.select("id", "score", "exact_match", *names).unionByName(E.failed_evaluations(rejects, metrics).select("id", "score", "exact_match", *names))
    return both.select("id", "score", "exact_match", *[F.round(c, 9).alias(c) for c in names])


@query("assemble_evaluation_rejects", with_view(JUDGED, "SELECT id FROM v WHERE CAST(json_extract_string(judge_json, '$.score') AS DOUBLE) NOT BETWEEN 1 AND 5"))
def _assemble_rejects(spark, folder):
    return E.assemble_evaluation(view(spark, folder, JUDGED))[1].select("id")


@query("safety_summary", with_view(JUDGED, """SELECT json_extract_string(judge_json, '$.safety_status') AS status, CAST(count(*) AS BIGINT) AS evaluations FROM v
  WHERE CAST(json_extract_string(judge_json, '$.score') AS DOUBLE) BETWEEN 1 AND 5 GROUP BY 1"""))
def _safety(spark, folder):
    return E.safety_summary(E.assemble_evaluation(view(spark, folder, JUDGED))[0])


def _responses(spark, folder):
    """Judge responses: by function call, by fenced text, by plain text, or broken."""
    rows = view(spark, folder, JUDGED).withColumn("n", F.col("id").cast("long") % 4)
    call = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(
        F.lit("submit_evaluation").alias("name"), F.col("judge_json").alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))

    def said(text):
        return F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))

    fenced = F.concat(F.lit("```json\n"), F.col("judge_json"), F.lit("\n```"))
    return rows.select("id", F.when(F.col("n") == 0, call).when(F.col("n") == 1, said(fenced)).when(F.col("n") == 2, said(F.col("judge_json")))
                       .otherwise(said(F.lit("I cannot judge this"))).alias("response"))


@query("parse_judge_output", with_view(JUDGED, "SELECT id, judge_json FROM v WHERE CAST(id AS BIGINT) % 4 <> 3"))
def _parse(spark, folder):
    return E.parse_judge_output(_responses(spark, folder))[0]


@query("parse_judge_rejects", with_view(JUDGED, "SELECT id FROM v WHERE CAST(id AS BIGINT) % 4 = 3"))
def _parse_rejects(spark, folder):
    return E.parse_judge_output(_responses(spark, folder))[1].select("id")


@query("local_retrieval_metrics", with_log("""SELECT id, round(len([x FOR x IN got IF list_contains(want, x)]) / CAST(2 AS DOUBLE), 9) AS recall_at_k,
  round(len([x FOR x IN got IF list_contains(want, x)]) / CAST(3 AS DOUBLE), 9) AS precision_at_k,
  coalesce(round(1.0 / list_min([i FOR i IN range(1, len(got) + 1) IF list_contains(want, got[i])]), 9), 0.0) AS mrr FROM (SELECT id, CAST(json_extract(metadata, '$.retrieved_ids') AS VARCHAR[]) AS got,
    CAST(json_extract(metadata, '$.relevant_ids') AS VARCHAR[]) AS want FROM r WHERE status <> 'error' AND output_message IS NOT NULL AND json_extract(metadata, '$.relevant_ids') IS NOT NULL) z"""))
def _local(spark, folder):
    rows = E.local_metrics(unpriced(spark, folder)).filter(F.col("recall_at_k").isNotNull())
    return rows.select("id", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("precision_at_k", 9).alias("precision_at_k"), F.round("mrr", 9).alias("mrr"))


# Expected answers repeat the answer for even events, so that exact match is known.
@query("apply_expected_answers", with_log("""SELECT r.id, CASE WHEN f.id IS NOT NULL AND r.output_message IS NOT NULL THEN
    CAST(regexp_extract(f.expected, '[0-9]+') = regexp_extract(json_extract_string(r.output_message, '$.content'), '[0-9]+') AS INT)
    ELSE CASE WHEN json_valid(r.evaluation) THEN CAST(json_extract_string(r.evaluation, '$.exact_match') AS INT) END END AS exact_match,
  CASE WHEN json_valid(r.evaluation) THEN CAST(json_extract_string(r.evaluation, '$.score') AS DOUBLE) END AS score, f.id IS NOT NULL AS answered
  FROM r LEFT JOIN f ON f.id = r.id""", """f AS (SELECT 'req_' || CAST(event_id AS VARCHAR) AS id, 'the answer ' || CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '777' END || '!' AS expected
    FROM events WHERE event_type IN ('click', 'view', 'error'))"""))
def _expected(spark, folder):
    events = table(spark, folder, "events").filter(F.col("event_type").isin("click", "view", "error"))
    k = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.lit("777"))
    news = events.select(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("id"),
                         F.to_json(F.struct(F.concat(F.lit("the answer "), k, F.lit("!")).alias("expected_answer"))).alias("feedback"))
    rows = E.apply_expected_answers(unpriced(spark, folder), news)
    return rows.select("id", F.get_json_object("evaluation", "$.exact_match").cast("int").alias("exact_match"),
                       F.get_json_object("evaluation", "$.score").cast("double").alias("score"),
                       F.get_json_object("feedback", "$.expected_answer").isNotNull().alias("answered"))
