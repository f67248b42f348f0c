"""The corpus pipeline: columns between stages, and run() against its stages in plain Python."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from calltrail.llm.quality import quality  # noqa: E402
from calltrail.llm.shared import written  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), name))
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and [t for _, t in df.dtypes] == [t for _, t in stages[0].dtypes]


def test_each_stage_by_brute_force(spark, folder, stages):
    raw, good, clean, single, whole = map(rows, stages[:5])
    verdicts = {r["doc_id"]: r["kept"] for r in quality(stages[0]).collect()}
    assert good == {k: r for k, r in raw.items() if verdicts[k]}
    hosts, on = {}, {}
    for k, r in good.items():
        hosts[r["source"]] = hosts.get(r["source"], 0) + 1
        for line in {x.strip() for x in r["text"].split("\n")} - {""}:
            on[r["source"], line] = on.get((r["source"], line), 0) + 1
    bad = {key for key, n in on.items() if n >= 3 and n > 0.1 * hosts[key[0]]}
    for k, r in good.items():
        left = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip()) not in bad)
        if left.strip():
            assert clean[k]["text"] == left and clean[k]["n_chars"] == len(left)
        else:
            assert k not in clean
    groups = brute.component_map({k: brute.shingles(r["text"]) for k, r in clean.items()})
    assert single == {k: r for k, r in clean.items() if groups[k] == k}
    items = [re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]).split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = set()
    for k, r in single.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]).split()
        grams = {tuple(w[i:i + 4]) for i in range(len(w))}
        for t in items:
            if any(tuple(t[i:i + 4]) in grams for i in range(len(t) - 3)) and brute.edits(t, w) <= int(0.2 * len(t)):
                leaked.add(k)
    assert whole == {k: r for k, r in single.items() if k not in leaked}
    packed = stages[5].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {k: len(brute.words(r["text"])) for k, r in whole.items()}


def test_run_equals_its_stages(spark, folder, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, stages[5].collect()))


def test_edge_rows_pass_through(spark, folder):
    docs = spark.createDataFrame(brute.edge_rows(), "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "extra": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, folder)
            n = got.count()
            assert n == 0 if table is not docs else n >= 0
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert got.columns == docs.columns


def test_near_dedup_from_a_similarity_of_80_percent(spark, folder):
    words = [f"w{i}" for i in range(104)]
    close = words[:94] + [f"v{i}" for i in range(10)]  # 90 of 110 shingles
    made = [(1, " ".join(words), "en", "a"), (2, " ".join(close), "en", "b"), (3, " ".join(words[:88] + [f"u{i}" for i in range(16)]), "en", "c")]  # 84 of 116
    a, b, c = (brute.shingles(r[1]) for r in made)
    assert 0.8 < len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.8
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    assert set(rows(corpus_pipeline.near_dedup(spark, docs, folder))) == {1, 3}


def test_large_group_of_copies_keeps_one(spark, folder):
    copy = "\n".join(" ".join(f"line{k}word{i}" for i in range(20)) for k in range(4))
    made = [(i, copy, "en", "a") for i in range(20)] + [(100 + i, "head of the site\n" + " ".join(f"x{i}y{k}" for k in range(60)), "en", "a") for i in range(40)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clean = written(corpus_pipeline.line_dedup(spark, docs, folder), "clean")
    got = rows(clean)
    assert all(got[i]["text"] == copy and got[i]["n_chars"] == len(copy) for i in range(20))
    assert all("head" not in got[100 + i]["text"] for i in range(40))
    assert set(rows(corpus_pipeline.near_dedup(spark, clean, folder))) == {0, *range(100, 140)}
