"""Lookups through the key index: the rows of a scan, few files opened, lagging and stale indexes."""

import pytest
from pyspark.sql import functions as F

from calltrail.operators.filters import lookup_requests
from calltrail.plans.views import unpriced
from calltrail.sources import lookup as K
from calltrail.sources.tables import load_table, write_requests


@pytest.fixture
def store(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    write_requests(unpriced(spark, folder), path)
    return path


def keys_of(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def rows(df):
    return sorted(map(tuple, df.select("id", "trace_id", "span_id", "conversation_id", "status").collect()), key=str)


def some(spark, store, column, n=3):
    return [r[0] for r in load_table(spark, store).filter(F.col(column) != "").select(column).distinct().orderBy(F.xxhash64(column)).limit(n).collect()]


@pytest.mark.parametrize("column", ["id", "span_id", "trace_id", "conversation_id"])
def test_rows_of_a_scan_from_few_files(spark, store, column):
    wanted = some(spark, store, column)
    keys = keys_of(spark, *wanted, wanted[0], "nobody", None, "")
    scan = rows(load_table(spark, store).filter(F.col(column).isin(wanted)))
    assert rows(K.rows_with(spark, store, column, keys)) == scan  # no index yet
    total = len(load_table(spark, store).inputFiles())
    assert K.update_index(spark, store) == total and K.update_index(spark, store) == 0
    assert rows(K.rows_with(spark, store, column, keys)) == scan
    files = K.files_with(spark, store, column, keys)
    holding = load_table(spark, store).filter(F.col(column).isin(wanted)).select("_metadata.file_path").distinct().count()
    assert len(files) == holding < total


def test_nothing_found_opens_no_file(spark, store):
    K.update_index(spark, store)
    assert K.files_with(spark, store, "id", keys_of(spark, "nobody")) == []
    assert K.rows_with(spark, store, "id", keys_of(spark, "nobody", None)).isEmpty()
    assert K.find_requests(spark, store, keys_of(spark, "nobody")).isEmpty()


def test_many_keys_are_joined(spark, store, monkeypatch):
    K.update_index(spark, store)
    wanted = some(spark, store, "trace_id", 40)
    whole = rows(K.rows_with(spark, store, "trace_id", keys_of(spark, *wanted)))
    monkeypatch.setattr(K, "FEW", 5)
    assert rows(K.rows_with(spark, store, "trace_id", keys_of(spark, *wanted))) == whole != []


def test_index_may_lag_and_files_may_go(spark, store):
    K.update_index(spark, store)
    log = load_table(spark, store)
    one = log.filter("trace_id <> ''").orderBy("id").limit(1).drop("day")
    trace = one.first()["trace_id"]
    write_requests(one.withColumn("id", F.lit("late")), store)
    keys = keys_of(spark, trace)
    assert "late" in {r["id"] for r in K.rows_with(spark, store, "trace_id", keys).collect()}
    assert K.update_index(spark, store) == 1
    assert rows(K.rows_with(spark, store, "trace_id", keys)) == rows(load_table(spark, store).filter(F.col("trace_id") == trace))
    # The day is written anew: its old files are gone, the new ones are not indexed yet.
    day = load_table(spark, store).filter(F.col("id") == "late").drop("day")
    kept = spark.createDataFrame(day.collect(), day.schema)
    write_requests(kept, store, mode="overwrite")
    assert rows(K.rows_with(spark, store, "trace_id", keys)) == rows(load_table(spark, store).filter(F.col("trace_id") == trace))


def test_requests_by_id_else_span(spark, store):
    K.update_index(spark, store)
    keys = keys_of(spark, *some(spark, store, "id"), *some(spark, store, "span_id"), "nobody", None)
    got = K.find_requests(spark, store, keys).select("key", "id").collect()
    want = lookup_requests(load_table(spark, store), keys).select("key", "id").collect()
    assert sorted(got) == sorted(want) and len(got) == 6


def test_condition_reaches_the_files_with_filters(spark, store):
    K.update_index(spark, store)
    wanted = some(spark, store, "id", 1)
    plan = K.rows_with(spark, store, "id", keys_of(spark, *wanted))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and wanted[0] in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
