"""Plans: what reaches the reader, and what must not appear."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from calltrail.functions.base import once
from calltrail.operators import analytics as A
from calltrail.operators import filters as B
from calltrail.operators.evaluation import text_fields
from calltrail.plans.views import requests

QUERIES = entry.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_and_pruning_reach_the_reader(spark, folder):
    text = plan(A.token_usage(requests(spark, folder), "2024-01-05", "2024-01-12"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in text and "LessThanOrEqual(ts,2024-01-12" in text
    text = plan(B.between(requests(spark, folder), "2024-01-05").select("id", "user_id"))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp,user_id:bigint", text)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_products(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_costly_columns_run_once(spark):
    df = spark.range(3).select(F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}")).alias("doc"))
    rows = once(df, r=text_fields("doc", ("a", "b"))).filter("r.a > 0").select("r.a", "r.b", F.col("r.a").alias("c"))
    assert plan(rows).count("from_json(") == 1 and [r["a"] for r in rows.collect()] == ["1", "2"]


def test_ranking_is_limited_before_the_shuffle(spark, folder):
    text = plan(QUERIES["import_logs"](spark, folder))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_big_price_list_is_not_broadcast(spark, folder):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(A.model_usage(requests(spark, folder), "2024-01-01", "2024-02-01"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
