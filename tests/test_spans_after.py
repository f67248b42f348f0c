"""Later spans for each anchor of a trace, with a trace that holds most spans, ties and missing values."""

import random
from datetime import datetime, timedelta

from calltrail.operators.traces import spans_after


def test_each_anchor_by_brute_force(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"s{i}", rng.choice(["hot", "hot", "hot", "a", "b", None]), start + timedelta(seconds=rng.randrange(900)) if i % 17 else None, "x") for i in range(600)]
    anchors = rows[::9] + [rows[9], ("late", "hot", start + timedelta(days=2), "x"), ("early", "hot", start - timedelta(days=2), "x"), ("else", "none", start, "x")]
    schema = "id string, trace_id string, created_at timestamp, note string"
    log, marks = (spark.createDataFrame(x, schema) for x in (rows, anchors))
    want = sorted((a[0], s[0]) for a in anchors for s in rows if a[1] and a[1] == s[1] and a[2] and s[2] and s[2] > a[2])
    for block in ("minute", "hour", "second"):
        assert sorted((r["anchor_id"], r["id"]) for r in spans_after(log, marks, block).collect()) == want
    assert spans_after(log, marks.limit(0)).count() == 0 and spans_after(log, marks).columns == ["anchor_id", *log.columns]
    plan = spans_after(log, marks)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
