"""Depth-first numbers, children and nested JSON of span trees against recursion in plain Python."""

import json
import random
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calltrail.operators import traces as T
from calltrail.operators import trees as N

T0 = datetime(2024, 1, 1)
DDL = "trace_id string, id string, span_id string, parent_span_id string, created_at timestamp"


def spans(spark, rows):
    return spark.createDataFrame([(t, i, s, p, None if x is None else T0 + timedelta(seconds=x)) for t, i, s, p, x in rows], DDL)


def walked(rows):
    """(nested by trace, figures by id) of rows without cycles or shared span ids."""
    sys.setrecursionlimit(10_000)
    key = {(t, s): i for t, i, s, p, x in rows if s is not None}
    at = {i: (x is not None, x or 0, i) for t, i, s, p, x in rows}
    kids, roots, span = {}, {}, {}
    for t, i, s, p, x in rows:
        span[i] = s
        up = key.get((t, p)) if p not in (None, "", "root") else None
        (kids.setdefault(up, []) if up else roots.setdefault(t, [])).append(i)
    figures, nested = {}, {}

    def visit(i, depth, count):
        first = count[0]
        count[0] += 1
        below = [visit(k, depth + 1, count) for k in sorted(kids.get(i, ()), key=at.get)]
        figures[i] = (depth, first, count[0] - 1)
        return {"id": i, **({"span_id": span[i]} if span[i] is not None else {}), "children": below}

    for t, tops in roots.items():
        count = [0]
        nested[t] = [visit(i, 0, count) for i in sorted(tops, key=at.get)]
    return nested, figures


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        trace = "hot" if rng.random() < 0.6 else f"t{rng.randrange(6)}"
        older = [r for r in rows if r[0] == trace]
        parent = rng.choice([None, "", "root", "absent", *[r[2] for r in older if r[2]][-3:]]) if older else None
        rows.append((trace, f"i{k}", None if rng.random() < 0.05 else f"s{k}", parent, rng.choice([None, rng.randrange(300), 7])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_and_nesting_equal_recursion(spark, seed):
    rows = random_rows(seed)
    tree, cycles = N.number_spans(spans(spark, rows))
    nested, figures = walked(rows)
    assert {r["id"]: (r["depth"], r["enter"], r["leave"]) for r in tree.collect()} == figures
    assert cycles.isEmpty()
    docs = {r["trace_id"]: json.loads(r["doc"]) for r in N.nested_documents(N.nested_parts(tree)).collect()}
    assert docs == nested


def test_children_follow_each_other(spark):
    tree, _ = N.number_spans(spans(spark, random_rows(3)))
    by_parent = {}
    for r in N.children(tree).collect():
        by_parent.setdefault((r["trace_id"], r["parent_id"]), []).append((r["enter"], r["next_enter"]))
    for edges in by_parent.values():
        edges.sort()
        assert [n for _, n in edges] == [e for e, _ in edges[1:]] + [None]
    assert sum(map(len, by_parent.values())) == tree.filter("parent_id IS NOT NULL").count()


def test_same_tree_as_by_paths_and_same_cycles(spark):
    log = spans(spark, random_rows(4) + [("c", "x", "c1", "c2", 5), ("c", "y", "c2", "c1", 6), ("c", "z", "c3", "c2", 7), ("c", "self", "me", "me", 8), ("c", "ok", "o", None, 9)])
    tree, cycles = N.number_spans(log)
    paths, lost = T.span_tree(log)
    assert [r["id"] for r in tree.orderBy("trace_id", "enter").collect()] == [r["id"] for r in T.flatten_tree(paths).collect()]
    assert {r["id"] for r in cycles.collect()} == {r["id"] for r in lost.collect()} == {"x", "y", "z", "self"}


def test_one_parent_of_most_spans_and_a_deep_chain(spark):
    wide = spark.range(20_000).select(F.lit("w").alias("trace_id"), F.format_string("k%06d", "id").alias("id"), F.col("id").cast("string").alias("span_id"),
                                      F.when(F.col("id") > 0, "0").alias("parent_span_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("created_at"))
    deep = spark.range(3_000).select(F.lit("d").alias("trace_id"), F.format_string("n%06d", "id").alias("id"), F.col("id").cast("string").alias("span_id"),
                                     F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("created_at"))
    tree, cycles = N.number_spans(wide.unionByName(deep))
    place = F.substring("id", 2, 6).cast("long")
    want = F.when(F.col("trace_id") == "w", F.when(F.col("enter") == 0, 20_000).otherwise(1)).otherwise(3_000 - place)
    assert tree.count() == 23_000 and tree.filter((F.col("enter") != place) | (F.col("size") != want)).isEmpty() and cycles.isEmpty()
    assert tree.filter("trace_id = 'd' AND depth <> enter").isEmpty()


def test_subtrees_are_ranges(spark):
    log = spans(spark, [("t", "r", "s0", None, 0), ("t", "a", "s1", "s0", 1), ("t", "b", "s2", "s0", 2), ("t", "c", "s3", "s1", 3), ("u", "q", "s0", None, 0)])
    tree, _ = N.number_spans(log)
    got = N.subtrees(tree, spark.createDataFrame([("t", "a"), ("t", "r"), ("u", "a"), ("t", "a")], "trace_id string, id string"))
    assert sorted((r["top_id"], r["id"]) for r in got.collect()) == [("a", "a"), ("a", "c"), ("r", "a"), ("r", "b"), ("r", "c"), ("r", "r")]


def test_empty_log(spark):
    tree, cycles = N.number_spans(spans(spark, []))
    assert tree.isEmpty() and cycles.isEmpty() and N.nested_parts(tree).isEmpty() and N.children(tree).isEmpty()


def test_any_fields_and_text_that_needs_escapes(spark):
    log = spans(spark, [("t", 'a"b', None, None, 0)])
    tree, _ = N.number_spans(log)
    parts = N.nested_parts(tree.withColumn("none", F.lit(None).cast("string")), ("id", "depth", "none"))
    assert json.loads(N.nested_documents(parts).first()["doc"]) == [{"id": 'a"b', "depth": 0, "children": []}]
    bare = N.nested_parts(tree.withColumn("none", F.lit(None).cast("string")), ("none",))
    assert N.nested_documents(bare).first()["doc"] == '[{"children":[]}]'
