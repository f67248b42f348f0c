"""Prompts by reference: joined parts are the prompts with their context inside, and each context is stored once."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from calltrail.operators import evaluation as E
from calltrail.sources.tables import conform_requests

T0 = datetime(2024, 1, 1)
DDL = "id string, trace_id string, span_type string, status string, input_messages string, output_message string, raw_response string, metadata string, created_at timestamp"


def log(spark, rows):
    return conform_requests(spark.createDataFrame([(*r, T0 + timedelta(seconds=k)) for k, r in enumerate(rows)], DDL))


def answer(text):
    return json.dumps({"role": "assistant", "content": text})


ASK = json.dumps([{"role": "user", "content": "why"}])


def joined(rows):
    parts, slices = E.judge_prompt_parts(rows), E.context_slices(rows)
    return {r["id"]: r["prompt"] for r in E.join_prompt_parts(parts, slices).collect()}


def inlined(rows):
    return {r["id"]: r["prompt"] for r in E.judge_inputs(rows).collect()}


def test_joined_parts_are_the_prompts(spark):
    rows = log(spark, [
        ("tool1", "t", "tool", "success", None, answer("found one"), None, None), ("tool2", "t", "tool", "success", None, None, "raw two", None),
        ("ask", "t", "llm", "success", ASK, answer("because"), None, None),
        ("own", "t", "llm", "success", ASK, answer("because"), None, json.dumps({"context": "mine", "expected_answer": "so"})),
        ("empty", "t", "llm", "success", ASK, answer("because"), None, json.dumps({"context": ""})),
        ("none", None, "llm", "success", ASK, answer("alone"), None, None), ("blank", "", "llm", "success", ASK, answer("alone"), None, None),
        ("bare", "u", "llm", "success", ASK, answer("no tools"), None, None), ("failed", "t", "llm", "error", ASK, answer("no"), None, None),
        ("hollow", "v", "tool", "success", None, '{"content": ""}', None, None), ("after", "v", "llm", "success", ASK, answer("x"), None, None)])
    want = inlined(rows)
    assert "found one\n\nraw two" in want["ask"] and "mine" in want["own"] and {"none", "blank", "bare", "after"} <= set(want)
    assert joined(rows) == want
    assert {r["id"]: r["context_of"] for r in E.judge_prompt_parts(rows).filter("position = 0").collect()} == {
        k: "t" for k in want if "found one" in want[k]}


def test_output_grows_with_the_log_not_with_its_square(spark):
    def size(n):
        tools = [(f"tool{k}", "t", "tool", "success", None, None, "x" * 100, None) for k in range(n)]
        asks = [(f"ask{k}", "t", "llm", "success", ASK, answer("because"), None, None) for k in range(n)]
        rows = log(spark, tools + asks)
        written = E.judge_prompt_parts(rows).agg(F.sum(F.length("text"))).first()[0] + E.context_slices(rows).agg(F.sum(F.length("text"))).first()[0]
        return written, sum(map(len, inlined(rows).values()))

    (small, small_inline), (large, large_inline) = size(20), size(80)
    assert large == 4 * small and large_inline > 10 * small_inline


def test_no_candidates(spark):
    rows = log(spark, [("a", "t", "llm", "error", ASK, None, None, None)])
    assert E.judge_prompt_parts(rows).isEmpty() and E.context_slices(rows).isEmpty() and joined(rows) == {}
