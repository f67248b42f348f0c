"""Trees, blocked numbering, contexts, diffs and changes on small hand-made tables."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calltrail.functions.text import diff_lines, lcs_length, shared_ngrams
from calltrail.operators import evaluation as E
from calltrail.operators import filters as B
from calltrail.operators import prompts as P
from calltrail.operators import traces as T
from calltrail.scale import number_within, previous_order
from calltrail.sources import changes as H
from calltrail.sources.tables import conform_requests

T0 = datetime(2024, 1, 1)


def span_rows(spark, rows):
    """(trace, id, span, parent, second) with the columns trees need."""
    return spark.createDataFrame([(t, i, s, p, T0 + timedelta(seconds=x)) for t, i, s, p, x in rows],
                                 "trace_id string, id string, span_id string, parent_span_id string, created_at timestamp")


def test_tree_shapes(spark):
    tree, cycles = T.span_tree(span_rows(spark, [
        ("t", "r", "s0", "root", 0), ("t", "b", "s2", "s0", 2), ("t", "a", "s1", "s0", 1), ("t", "c", "s3", "s1", 3),
        ("t", "orphan", "s9", "missing", 4), ("t", "x", "c1", "c2", 5), ("t", "y", "c2", "c1", 6), ("t", "z", "c3", "c2", 7),
        ("t", "self", "me", "me", 8), ("u", "other", "s5", "s0", 0), ("u", "nospan", None, "", 1), ("", "none", "s", None, 0)]))
    got = {r["id"]: (r["root_id"], r["depth"], r["parent_id"]) for r in tree.collect()}
    assert got == {"r": ("r", 0, None), "a": ("r", 1, "r"), "b": ("r", 1, "r"), "c": ("r", 2, "a"), "orphan": ("orphan", 0, None),
                   "other": ("other", 0, None), "nospan": ("nospan", 0, None)}
    assert {r["id"] for r in cycles.collect()} == {"x", "y", "z", "self"}
    order = [r["id"] for r in T.flatten_tree(tree).filter("trace_id = 't'").collect()]
    assert order == ["r", "a", "c", "b", "orphan"]


def test_tree_deep_chain_and_wide_root(spark):
    chain = [("d", f"n{i}", f"s{i}", f"s{i - 1}" if i else None, i) for i in range(100)]
    wide = [("w", "root", "s", None, 0)] + [("w", f"k{i}", f"x{i}", "s", i) for i in range(500)]
    tree, cycles = T.span_tree(span_rows(spark, chain + wide))
    depth = {r["id"]: r["depth"] for r in tree.collect()}
    assert all(depth[f"n{i}"] == i for i in range(100)) and cycles.count() == 0
    assert all(depth[f"k{i}"] == 1 for i in range(500))


def test_shared_span_id_uses_newest(spark):
    tree, _ = T.span_tree(span_rows(spark, [("t", "old", "s", None, 0), ("t", "new", "s", None, 1), ("t", "kid", "k", "s", 2)]))
    assert {r["id"]: r["parent_id"] for r in tree.collect()}["kid"] == "new"


def test_numbering_with_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", n) for n in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "name string, seq long")
    want, before = {}, {}
    for name, n in sorted(rows):
        mates = sorted(s for k, s in rows if k == name)
        want[(name, n)] = mates.index(n) + 1
        before[(name, n)] = mates[mates.index(n) - 1] if mates.index(n) else None
    assert {(r[0], r[1]): r["position"] for r in number_within(df, ["name"], "seq", block=50).collect()} == want
    assert {(r[0], r[1]): r["previous"] for r in previous_order(df, ["name"], "seq", block=50).collect()} == before


def test_large_context_is_whole(spark):
    rows = [("big", f"b{i:03d}", T0 + timedelta(seconds=20 * i), "tool", f'{{"role":"assistant","content":"out {i}"}}', None) for i in range(30)]
    rows += [("small", "s1", T0, "tool", None, "raw"), ("small", "s0", T0, "tool", "{bad", "ignored"), ("small", "s2", T0, "llm", '{"content":"no"}', None)]
    df = spark.createDataFrame(rows, "trace_id string, id string, created_at timestamp, span_type string, output_message string, raw_response string")
    got = {r["trace_id"]: r["context"] for r in T.gather_tool_context(df).collect()}
    assert got == {"big": "\n\n".join(f"out {i}" for i in range(30)), "small": "raw"}


def _brute_lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp


WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_lcs_against_table(a, b):
    assert lcs_length(a, b) == _brute_lcs(a, b)[-1][-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_diff_against_table(a, b):
    old, new = "\n".join(a), "\n".join(b)
    x, y = old.split("\n"), new.split("\n")
    dp = _brute_lcs(x, y)
    i, j, want = len(x), len(y), []
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            want.append(("unchanged", x[i - 1]))
            i, j = i - 1, j - 1
        elif j and (i == 0 or dp[i][j - 1] >= dp[i - 1][j]):
            want.append(("added", y[j - 1]))
            j -= 1
        else:
            want.append(("removed", x[i - 1]))
            i -= 1
    assert [(e["type"], e["text"]) for e in diff_lines(old, new)] == want[::-1]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.integers(1, 4))
def test_shared_ngrams(a, b, n):
    left = [tuple(a[i:i + n]) for i in range(len(a) - n + 1)]
    right = [tuple(b[i:i + n]) for i in range(len(b) - n + 1)]
    hits = 0
    for g in left:
        if g in right:
            right.remove(g)
            hits += 1
    assert shared_ngrams(a, b, n) == hits


def test_prompt_diff_modes(spark):
    prompts = spark.createDataFrame([("p", 1, "a\nb"), ("p", 4, "a\nc"), ("p", 9, "a"), ("q", 2, "z")], "name string, version long, user_template string")
    steps = {(r["from_version"], r["to_version"], r["line_no"]): (r["type"], r["text"]) for r in P.prompt_diff(prompts).collect()}
    assert steps == {(1, 4, 0): ("unchanged", "a"), (1, 4, 1): ("removed", "b"), (1, 4, 2): ("added", "c"),
                     (4, 9, 0): ("unchanged", "a"), (4, 9, 1): ("removed", "c")}
    latest = {(r["from_version"], r["to_version"]) for r in P.prompt_diff(prompts, against="latest").collect()}
    assert latest == {(1, 9), (4, 9)}
    assert P.delete_prompts(prompts, spark.createDataFrame([("p",)], "name string")).count() == 1


def test_changes_keep_explicit_null(spark):
    base = conform_requests(spark.createDataFrame([("a", "{}", "ok"), ("b", "{}", "ok")], "id string, feedback string, status string"))
    changes = spark.createDataFrame([("a", "feedback", None, 2), ("a", "feedback", "x", 1), ("b", "colour", "red", 3), ("b", "tags", "no array", 4)],
                                    "id string, field string, value string, seq long")
    done, rejects = H.merge_changes(base, changes)
    assert {r["id"]: r["feedback"] for r in done.collect()} == {"a": None, "b": "{}"}
    assert sorted(r["reason"] for r in rejects.collect()) == ["tags must be an array", "unknown field"]


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("a", 1)], "id string, n long")
    new = spark.createDataFrame([("a", 2), ("b", 5), ("b", 3)], "id string, n long")
    done, rejects = H.insert_if_absent(base, new, "id", "n")
    assert sorted(map(tuple, done.collect())) == [("a", 1), ("b", 3)]
    assert sorted((r["id"], r["n"], r["reason"]) for r in rejects.collect()) == [("a", 2, "key exists"), ("b", 5, "repeated key")]


def test_page_limits(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("id"), F.col("id").alias("total_tokens"), F.lit(T0).alias("created_at"))
    rows, info = B.page(df, page=1, limit=9999, sort_by="bogus")
    assert rows.count() == 500 and tuple(info.first()) == (600, 1, 500, 2)
    rows, _ = B.page(df, page=0, sort_by="total_tokens", sort_order="asc")
    assert [r["total_tokens"] for r in rows.collect()] == list(range(50))
    after = B.page_after(df, 49, "49", limit=3, sort_by="total_tokens", sort_order="asc")
    assert [r["total_tokens"] for r in after.collect()] == [50, 51, 52]


def test_judge_rules(spark):
    rows = [("1", '{"score": 4.26, "task_metrics": ["fluency", "coherence", "made_up"], "fluency": 5.1, "coherence": "4.44", "applicable_metrics": ["faithfulness", "hallucination_rate", "ground_truth_alignment"], "faithfulness": 4.26, "hallucination_rate": 0.126, "answer_relevancy": 3}'),
            ("2", '{"score": "abc"}'), ("3", '{"score": 0.99}'), ("4", '{"score": 5, "category": "", "task_type": "general", "safety_status": "flagged", "applicable_metrics": ["faithfulness"], "faithfulness": 2}')]
    parsed = spark.createDataFrame(rows, "id string, judge_json string")
    candidates = spark.createDataFrame([("1", "docs"), ("4", "")], "id string, context string")
    metrics = spark.createDataFrame([("1", 1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.1, 0.2, 0.3), ("4", 1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.4, 0.5, 0.6)],
                                    "id string, exact_match int, f1_score double, rouge_1 double, rouge_2 double, rouge_l double, bleu double, recall_at_k double, precision_at_k double, mrr double")
    done, rejects = E.assemble_evaluation(parsed, candidates, metrics)
    got = {r["id"]: r for r in done.collect()}
    assert {r["id"] for r in rejects.collect()} == {"2", "3"}
    assert got["1"]["score"] == 4.3 and got["1"]["fluency"] is None and got["1"]["coherence"] == 4.4 and got["1"]["task_metrics"] == ["coherence"]
    assert got["1"]["faithfulness"] == 4.3 and got["1"]["hallucination_rate"] == 0.13 and got["1"]["answer_relevancy"] is None
    assert got["1"]["f1_score"] == 0.5 and got["1"]["recall_at_k"] == 0.1 and got["1"]["safety"] is None
    assert got["4"]["category"] == "helpfulness" and got["4"]["faithfulness"] is None and got["4"]["f1_score"] is None and got["4"]["mrr"] == 0.6
    assert got["4"]["safety"]["status"] == "flagged"
    texts = {r["id"]: r["evaluation"] for r in E.evaluation_json(done).collect()}
    assert '"score":4.3' in texts["1"] and "fluency" not in texts["1"].replace('["', "")
    kept = E.failed_evaluations(spark.createDataFrame([("1", "bad")], "id string, reason string"), metrics).first()
    assert kept["score"] == 0 and kept["mrr"] == 0.3


def test_expected_answer_replaces_old_text_metrics(spark):
    base = conform_requests(spark.createDataFrame(
        [("a", '{"content":"x y"}', '{"score":3,"bleu":0.5,"exact_match":0}'), ("b", '{"content":"x"}', "broken"), ("c", None, '{"score":1}')],
        "id string, output_message string, evaluation string"))
    news = spark.createDataFrame([(i, '{"expected_answer":"x y"}') for i in "abc"], "id string, feedback string")
    rows = {r["id"]: r["evaluation"] for r in E.apply_expected_answers(base, news).collect()}
    import json
    a = json.loads(rows["a"])
    assert a["score"] == 3 and a["exact_match"] == 1 and rows["a"].count("bleu") == 1
    assert json.loads(rows["b"])["exact_match"] == 0 and rows["c"] == '{"score":1}'
    judged = spark.createDataFrame([("a", '{"score":5}')], "id string, evaluation string")
    assert {r["id"]: r["evaluation"] for r in E.apply_expected_answers(base, news, judged).collect()}["a"] == '{"score":5}'


def test_agent_figures_replace_old_ones(spark):
    import json
    base = conform_requests(spark.createDataFrame(
        [("r", "t", None, '{"score":2,"iteration_count":9,"reasoning":"say \\"iteration_count\\": 1"}'), ("k", "t", "x", '{"score":1}'), ("s", "u", None, None)],
        "id string, trace_id string, parent_span_id string, evaluation string").withColumn("created_at", F.lit(T0)))
    rows = {r["id"]: r["evaluation"] for r in T.with_agent_metrics(base).collect()}
    doc = json.loads(rows["r"])
    assert doc["iteration_count"] == 2 and doc["score"] == 2 and doc["reasoning"] == 'say "iteration_count": 1' and rows["r"].count('"iteration_count":') == 1
    assert rows["k"] == '{"score":1}' and json.loads(rows["s"])["goal_completion_rate"] == 1


def test_evaluation_analytics_denominators(spark):
    rows = [("success", '{"rating":4,"task_success":true}', '{"faithfulness":4,"recall_at_k":0.5}'), ("error", '{"rating":null}', '{"recall_at_k":1}'),
            ("success", "bad", '{"hallucination_rate":0.25}'), ("success", None, "[1]")]
    df = spark.createDataFrame([(s, f, e, 10, 0.1, 5, T0) for s, f, e in rows],
                               "status string, feedback string, evaluation string, latency_ms long, estimated_cost double, total_tokens long, created_at timestamp")
    r = E.evaluation_analytics(df, "2024-01-01", "2024-01-01 00:02:00").first()
    assert r["faithfulness"] == 2.0 and r["recall_at_k"] == 0.75 and r["hallucination_rate"] == 0.25
    assert r["avg_rating"] == 4.0 and r["rating_count"] == 1 and r["task_success_rate"] == 50 and r["throughput"] == 2.0 and r["error_rate"] == 25.0
