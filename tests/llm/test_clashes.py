"""Columns of the user whose names are those of inner columns pass every stage and helper unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from calltrail.llm.lines import drop_boilerplate
from calltrail.llm.shared import free_name, split_likely, without, written

NAMES = ["_bucket", "_bits", "_likely", "_bad", "_host", "_n_lines", "_n_dropped", "_N_LINES_", "host", "lines", "count", "component", "component_id",
         "kept", "band", "bucket", "targets", "key", "language", "low", "high", "surprise", "n_words", "item_id", "found", "p", "texts"]


@pytest.fixture(scope="module")
def docs(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return written(df.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in NAMES}), "clashing")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stage_lets_columns_pass(spark, folder, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = out.select("doc_id", *NAMES).collect()
    assert got and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in NAMES)
    bare = stage(spark, docs.drop(*NAMES), folder)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in bare.select("doc_id").collect())


def test_packing_looks_at_its_own_columns_only(spark, folder, docs):
    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    assert stage(spark, docs, folder).count() == stage(spark, docs.drop(*NAMES), folder).count()


def test_helpers_keep_columns_and_values(spark, docs):
    keys = written(docs.filter("doc_id % 3 = 0").select("doc_id"), "keys")
    left = without(docs, keys, "doc_id")
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.select("doc_id", "_bucket", "_likely").collect())) == sorted((r["doc_id"], r["_bucket"], r["_likely"]) for r in docs.collect() if r["doc_id"] % 3)
    assert all(part.columns == docs.columns for part in split_likely(docs, keys, "doc_id"))


def test_line_counts_under_free_names(spark):
    df = spark.createDataFrame([("h", f"menu\nline {i}", i) for i in range(4)], "_host string, _bad string, _n_lines int")
    name = free_name(df, "_n_lines")
    out = drop_boilerplate(df, "_host", "_bad", n_lines=name)
    assert sorted(tuple(r) for r in out.collect()) == [("h", f"line {i}", i, 2, 1) for i in range(4)]
    assert name == "_n_lines_" and free_name(spark.range(1).selectExpr("id AS A"), "a") == "a_"
