"""Hand-worked values of column functions and small operators."""

import math
from datetime import datetime

import pytest
from conftest import one
from pyspark.sql import functions as F

from calltrail.functions import messages as M
from calltrail.functions import pii
from calltrail.functions import text as X
from calltrail.functions.base import js_round, js_trim, number_text, utf16_length
from calltrail.functions.retrieval import mrr, precision_at_k, recall_at_k
from calltrail.operators import analytics as A
from calltrail.operators import filters as B
from calltrail.operators import metrics as K


@pytest.mark.parametrize("text, masked", [
    ("My email is check@example.com and Visa is 4111-2222-3333-4444.", "My email is [EMAIL_REDACTED] and Visa is [CARD_REDACTED]."),
    ("phone: 415-555-2671", "phone: [PHONE_REDACTED]"),
    ("+1 (555) 019-2834", "+1 ([PHONE_REDACTED]"),
    ("id 12345678", "id [PHONE_REDACTED]"),
    ("id 1234567", "id 1234567"),
    ("é4111222233334444", "é[CARD_REDACTED]"),
    ("x4111222233334444", "x4111222233334444"),
    ("tel 415 555 2671", "tel [PHONE_REDACTED]"),
    ("a+49 170 1234567", "a[PHONE_REDACTED]"),  # a boundary lies between "a" and "+"
    ("", ""), (None, None)])
def test_mask_pii(spark, text, masked):
    assert one(spark, pii.mask_pii(F.lit(text).cast("string"))) == masked


def test_mask_pii_json(spark):
    doc = '{"a@b.com":"c@d.org","n":41112222333344,"l":["415-555-2671",{"x":"é"}],"z":null}'
    assert one(spark, pii.mask_pii_json(F.lit(doc))) == '{"a@b.com":"[EMAIL_REDACTED]","n":41112222333344,"l":["[PHONE_REDACTED]",{"x":"é"}],"z":null}'
    assert one(spark, pii.mask_pii_json(F.lit('{"a":"\\n12345678"}'))) == '{"a":"\\n[PHONE_REDACTED]"}'
    assert one(spark, pii.mask_pii_json(F.lit("not json a@b.com"))) == "not json [EMAIL_REDACTED]"


def _messages(*pairs):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("content")) for r, c in pairs])


def test_guardrail(spark):
    talk = _messages(("user", None), ("user", "a DDoS attack"), ("user", "malware, exploit"))
    assert one(spark, pii.guardrail_check(_messages(("user", "a ddos attack"))))["blocked"] is False
    hit = one(spark, pii.guardrail_check(talk))
    assert (hit["blocked"], hit["keyword"]) == (True, "exploit")
    assert one(spark, pii.guardrail_check(talk, " ddos , ,exploit"))["keyword"] == "ddos"
    assert one(spark, pii.guardrail_check(talk, " , "))["blocked"] is False


def test_base(spark):
    assert one(spark, js_round(F.lit(-2.5))) == -2
    assert one(spark, js_round(F.lit(0.125), 2)) == 0.13
    assert one(spark, utf16_length(F.lit("a😀"))) == 3
    assert one(spark, js_trim(F.lit("  x\n"))) == "x"
    for value, text in ((0.000935, "0.000935"), (12.0, "12"), (0.1, "0.1"), (0.0, "0"), (1e-6, "0.000001"), (123456789.25, "123456789.25"), (100.0, "100")):
        assert one(spark, number_text(F.lit(value))) == text


def test_estimate_tokens(spark):
    got = one(spark, M.estimate_tokens(_messages(("user", "hello")), F.lit("ok")))
    assert tuple(got) == (3, 1)
    assert tuple(one(spark, M.estimate_tokens(F.array().cast("array<struct<role:string,content:string>>"), F.lit(None).cast("string")))) == (1, 1)


def test_templates(spark):
    text = F.lit("Hi {{ name }} {{x}} {{name}}")
    assert one(spark, M.template_variables(text)) == ["name", "x"]
    assert one(spark, M.template_variables(F.lit(None).cast("string"))) == []
    bind = F.create_map(F.lit("name"), F.lit("{{x}}"))
    assert one(spark, M.fill_template(F.lit("Hi {{ name }} {{x}}"), bind)) == "Hi {{x}} {{x}}"
    assert one(spark, M.fill_template(F.lit(None).cast("string"), bind)) == ""
    assert one(spark, M.fill_template(F.lit("plain"), bind)) == "plain"


def test_labels(spark):
    assert one(spark, M.model_leaf(F.lit("a/b/c"))) == "c"
    assert one(spark, M.model_leaf(F.lit(None).cast("string"))) == "Unknown"
    assert one(spark, M.task_title(F.lit("code_generation"))) == "Code Generation"
    assert [one(spark, M.score_band(F.lit(s))) for s in (4.0, 3.9, 2.99, None)] == ["high", "mid", "low", "low"]
    assert [one(spark, M.mask_secret(F.lit(s))) for s in ("123456789", "12345678", "", None)] == ["1234...6789", "********", "", ""]
    assert one(spark, M.classify_task_keywords(F.lit("Please REWRITE this function"))) == "paraphrase"
    assert one(spark, M.parse_created_at(F.lit("2024-01-02 03:04:05"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, M.parse_created_at(F.lit("2024-01-02T03:04:05.678Z"))) == datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert one(spark, M.parse_created_at(F.lit("yesterday"))) is None


@pytest.mark.parametrize("rating, score", [(5, 1), (4, 1), (3, None), (2, -1), (1, -1)])
def test_derive_feedback(spark, rating, score):
    none = F.lit(None)
    assert one(spark, M.derive_feedback(none, F.lit(rating), none, none, none))["score"] == score
    assert one(spark, M.derive_feedback(F.lit(-1), F.lit(rating), none, none, none))["score"] == -1
    assert one(spark, M.derive_feedback(none, F.lit(rating), none, none, none, F.lit(True)))["score"] is None


def test_tool_io(spark):
    def io(content, out=None, rq=None, rs=None):
        doc = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.lit(content).alias("content"))))
        return tuple(one(spark, M.tool_io(doc, F.lit(out).cast("string"), F.lit(rq).cast("string"), F.lit(rs).cast("string"))))
    assert io("Input:  a b \nOutput: c\nOutput: d ") == ("a b", "c\nOutput: d")
    assert io("Input: only", "out", "rq") == ("rq", "out")
    assert io("x", None, None, "rs") == ('[{"role":"user","content":"x"}]', "rs")


def test_canonical(spark):
    def inputs(doc, raw=None):
        rows = one(spark, M.canonical_inputs(F.lit(doc).cast("string"), F.lit(raw).cast("string")))
        return [tuple(r) for r in rows]
    assert inputs('[{"role":"user","content":"a"}]') == [("user", "a")]
    assert inputs(None, '{"messages":[{"role":"system","content":"b"}]}') == [("system", "b")]
    assert inputs('{"k": 1}') == [("user", '{"k":1}')]
    assert inputs('"hello"') == [("user", "hello")]
    assert inputs("{bad") == [] and inputs("0") == [] and inputs(None) == []

    def output(doc, raw=None):
        row = one(spark, M.canonical_output(F.lit(doc).cast("string"), F.lit(raw).cast("string")))
        return row and tuple(row)
    assert output('{"role":"assistant","content":"x"}') == ("assistant", "x")
    assert output('{"tool": "t"}') == ("assistant", '{"tool":"t"}')
    assert output(None, '{"choices":[{"message":{"role":"assistant","content":"y"}}]}') == ("assistant", "y")
    assert output('"text"') == ("assistant", "text")
    assert output("{bad") is None and output(None) is None


def test_text_metrics(spark):
    pairs = spark.createDataFrame([
        (1, "The cat sat", "a cat ran fast"), (2, "", "x"), (3, "same words here now", "Same words, here: now!"), (4, "x", ""), (5, "España", "España"),
        (6, "a b", None)], "k int, generated string, expected string")
    rows = {r["k"]: r for r in K.text_metrics(pairs, "k").collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert math.isclose(rows[1]["f1_score"], 0.4) and math.isclose(rows[1]["rouge_l"], 1 / 3) and rows[1]["rouge_2"] == 0
    assert math.isclose(rows[1]["bleu"], 0.510029, abs_tol=1e-6) and rows[1]["exact_match"] == 0
    assert rows[2]["f1_score"] == rows[2]["rouge_1"] == rows[2]["bleu"] == rows[2]["rouge_l"] == 0
    assert all(math.isclose(rows[3][m], 1) for m in ("f1_score", "rouge_1", "rouge_2", "rouge_l", "bleu")) and rows[3]["exact_match"] == 1
    for single, name in ((K.token_f1(pairs, "k"), "f1_score"), (K.rouge_n(pairs, "k", 1), "rouge_1"), (K.rouge_n(pairs, "k", 2), "rouge_2"),
                         (K.rouge_l(pairs, "k"), "rouge_l"), (K.bleu4(pairs, "k"), "bleu")):
        for r in single.filter("k in (1, 2, 3, 5)").collect():
            assert math.isclose(r[name], rows[r["k"]][name], abs_tol=1e-12)


def test_normalize(spark):
    assert one(spark, X.normalize_text(F.lit("The  A+b [x] 'quoted' an\tend."))) == "+b [x] 'quoted' end"
    assert one(spark, X.normalize_text(F.lit("España l'an"))) == "españ l'"
    assert one(spark, X.normalize_text(F.lit(None).cast("string"))) == ""


def test_retrieval(spark):
    got, want = F.array(*map(F.lit, (5, 2, 9, 1))), F.array(F.lit("9"), F.lit("7"))
    assert one(spark, recall_at_k(got, want)) == 0.5 and one(spark, precision_at_k(got, want)) == 0.25
    assert math.isclose(one(spark, mrr(got, want)), 1 / 3)
    assert one(spark, recall_at_k(got, want, 2)) == 0 and one(spark, precision_at_k(got, want, 0)) == 0
    none = F.lit(None).cast("array<int>")
    empty = F.array().cast("array<int>")
    for f in (recall_at_k, precision_at_k, mrr):
        assert one(spark, f(none, want)) == 0 and one(spark, f(got, none)) == 0 and one(spark, f(empty, want)) == 0 and one(spark, f(got, empty)) == 0
    twice = F.array(F.lit(9), F.lit(9))
    assert one(spark, recall_at_k(twice, want)) == 1.0


def test_period_change(spark):
    for cur, prev, want in ((5, 0, 100), (0, 0, 0), (3, 4, -25)):
        assert one(spark, A.pct_change(F.lit(cur), F.lit(prev))) == want


def test_nearest_rank(spark):
    rows = spark.range(1, 21).select(F.lit(datetime(2024, 1, 1)).alias("created_at"), F.lit("success").alias("status"), F.col("id").alias("latency_ms"))
    got = A.latency_stats(rows, "2024-01-01", "2024-01-02").first()
    assert (got["p50"], got["p95"], got["p99"], got["avg"]) == (10, 19, 20, 11)
    rough = A.latency_stats(rows, "2024-01-01", "2024-01-02", exact=False).first()
    assert (rough["p50"], rough["p95"], rough["p99"]) == (10, 19, 20)


def test_date_range():
    now = datetime(2024, 3, 10, 15, 30)
    assert B.resolve_date_range(now) == (datetime(2024, 3, 3, 15, 30), now)
    assert B.resolve_date_range(now, preset="24h") == (datetime(2024, 3, 9, 15, 30), now)
    assert B.resolve_date_range(now, preset="7d") == (datetime(2024, 3, 4), now)
    assert B.resolve_date_range(now, end=datetime(2024, 1, 8)) == (datetime(2024, 1, 1), datetime(2024, 1, 8))


def test_overview_of_nothing(spark):
    empty = spark.createDataFrame([], "created_at timestamp, status string, estimated_cost double, latency_ms long, total_tokens long, prompt_tokens long, completion_tokens long")
    row = A.overview(empty, "2024-01-01", "2024-01-02").first()
    assert row["total_requests"] == 0 and row["error_rate"] == 0 and row["requests_change"] == 0 and row["avg_latency"] == 0
    assert A.latency_stats(empty, "2024-01-01", "2024-01-02").count() == 0
