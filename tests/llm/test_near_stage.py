"""The pipeline's near-dedup stage against brute force at the similarity that it takes, 0.8, and line dedup's rule for emptied documents."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from calltrail.llm.minhash import NEAR  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_near_dedup_keeps_one_of_each_group_at_80_percent(spark, folder):
    for sf in (folder, folder.replace("sf0.001", "sf0.01")):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        every = rows(docs)
        groups = brute.component_map({k: brute.shingles(r["text"]) for k, r in every.items()}, percent=80)
        assert rows(STAGES["minhash_near_dedup"](spark, docs, sf)) == {k: r for k, r in every.items() if groups[k] == k}
    assert NEAR["percent"] == 80


def test_line_dedup_keeps_a_document_that_would_lose_all(spark, folder):
    data = [(i, "same line\nother same line", "en", "s", 25) for i in range(5)] + [(i, f"same line\nown {i}", "en", "s", 15) for i in range(5, 9)]
    got = rows(STAGES["line_dedup"](spark, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), folder))
    assert [got[i]["text"] for i in range(9)] == ["same line\nother same line"] * 5 + [f"own {i}" for i in range(5, 9)]
    assert [got[i]["n_chars"] for i in range(9)] == [25] * 5 + [5] * 4
