"""One trace, conversation, model and day holding most rows: results equal a plain computation."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calltrail.operators import analytics as A
from calltrail.operators import conversations as V
from calltrail.operators import evaluation as E
from calltrail.operators import traces as T
from calltrail.plans.views import requests


@pytest.fixture(scope="module")
def log(spark, folder):
    number = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    hot = number % 10 < 7
    base = requests(spark, folder)
    return base.withColumn("trace_id", F.when(hot, F.lit("hot")).otherwise(F.col("trace_id"))).withColumn(
        "conversation_id", F.when(hot, F.lit("hot")).otherwise(F.col("conversation_id"))).withColumn(
        "parent_span_id", F.when(hot & (number > 0), F.lit("span_0")).otherwise(F.col("parent_span_id")))


@pytest.fixture(scope="module")
def rows(log):
    return sorted(log.collect(), key=lambda r: (r["created_at"], r["id"]))


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        if r[key]:
            out[r[key]].append(r)
    return out


def test_rollups(log, rows):
    traces = grouped(rows, "trace_id")
    got = {r["trace_id"]: r for r in T.trace_sessions(log).collect()}
    assert set(got) == set(traces) and len(traces["hot"]) > len(rows) * 0.6
    agents = {r["trace_id"]: r for r in T.agent_metrics(log).collect()}
    for trace, spans in traces.items():
        root = next((s for s in spans if s["parent_span_id"] in (None, "", "root")), None)
        assert got[trace]["total_spans"] == len(spans) and got[trace]["total_latency_ms"] == sum(s["latency_ms"] for s in spans)
        assert got[trace]["name"] == ((root and root["span_name"]) or spans[0]["span_name"] or "Trace Session")
        tools = [s for s in spans if s["span_type"] == "tool"]
        rate = sum(s["status"] == "success" for s in tools) / len(tools) if tools else 1.0
        assert agents[trace]["tool_success_rate"] == pytest.approx(rate) and agents[trace]["iteration_count"] == len(spans)
        head = next((s for s in spans if s["parent_span_id"] in (None, "", "root") or s["span_type"] == "agent"), spans[0])
        assert agents[trace]["root_id"] == head["id"]
    talks = grouped(rows, "conversation_id")
    assert {r["id"]: r["total_messages"] for r in V.conversation_rollup(log).collect()} == {k: len(v) for k, v in talks.items()}


def test_tree(log, rows):
    tree, cycles = T.span_tree(log)
    depth = {r["id"]: r["depth"] for r in tree.collect()}
    assert len(depth) + cycles.count() == sum(bool(r["trace_id"]) for r in rows)
    assert all(depth[r["id"]] == (0 if r["id"] == "req_0" else 1) for r in rows if r["trace_id"] == "hot")


def test_contexts(log, rows):
    spans = [s for s in grouped(rows, "trace_id")["hot"] if s["span_type"] == "tool"]
    texts = []
    for s in spans:
        text = s["output_message"] and s["output_message"].split('"content":"')[1][:-2]
        text = text or (None if s["output_message"] else s["raw_response"])
        if text:
            texts.append(text)
    whole = "\n\n".join(texts)
    assert [r["context"] for r in T.gather_tool_context(log).filter("trace_id = 'hot'").collect()] == [whole]
    inputs = E.judge_inputs(log)
    hot = inputs.filter("trace_id = 'hot'")
    assert hot.filter(F.col("context").isNull()).isEmpty() and hot.filter(F.contains("prompt", F.lit(whole))).count() > 0
    assert E.judge_inputs(log, inline_context=False).count() == inputs.count()
    assert inputs.count() == E.eval_candidates(log).count()


def test_latency_of_one_day(log, rows):
    day = log.withColumn("created_at", F.lit("2024-01-05").cast("timestamp"))
    values = sorted(r["latency_ms"] for r in rows if r["status"] != "error")
    got = A.latency_stats(day, "2024-01-05", "2024-01-06").first()
    n = len(values)
    for p in (50, 95, 99):
        assert got[f"p{p}"] == values[-(-p * n // 100) - 1]


def test_replay_orders_every_row(log, rows):
    replay = T.trace_replay(log).filter("trace_id = 'hot'").collect()
    keys = [(r["created_at"], r["id"], r["position"]) for r in replay]
    assert keys == sorted(keys) and {k[1] for k in keys} <= {r["id"] for r in rows}
