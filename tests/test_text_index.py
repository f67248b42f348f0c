"""Substring search through the index of three-byte sequences: the rows of a scan, few files opened, lagging indexes, long texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calltrail.operators.filters import search_requests
from calltrail.plans.views import unpriced
from calltrail.sources import text_index as X
from calltrail.sources.tables import load_table, write_requests


def written(spark, folder, path):
    log = unpriced(spark, folder)
    rare = log.limit(1).withColumns({"id": F.lit("rare"), "input_messages": F.lit('[{"role":"user","content":"ÄRGER mit 50\\\\% Zebrafinken_7"}]'), "output_message": F.lit(None).cast("string")})
    write_requests(log, path)
    write_requests(rare, path)
    return path


@pytest.fixture
def store(spark, folder, tmp_path):
    return written(spark, folder, str(tmp_path / "log"))


@pytest.fixture(scope="module")
def indexed(spark, folder, tmp_path_factory):
    path = written(spark, folder, str(tmp_path_factory.mktemp("indexed") / "log"))
    X.update_text_index(spark, path)
    return path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("term", ["zebrafinken_7", "ZEBRA%ken", "Ärger", "ärger", "zeb_afin", "50\\% Z", "user1_@EXAMPLE", "no such text at all", "a", "ze", "%", "", "\\", "z%e%b", "日本語"])
def test_rows_of_a_scan(spark, indexed, term):
    assert ids(X.search_stored(spark, indexed, term)) == ids(search_requests(load_table(spark, indexed), term))


def test_few_files_are_read(spark, store):
    total = len(load_table(spark, store).inputFiles())
    assert ids(X.search_stored(spark, store, "zebraFINKEN")) == ["rare"]  # no index yet
    assert X.update_text_index(spark, store) == total and X.update_text_index(spark, store) == 0
    assert total > 1 and len(X.files_of_term(spark, store, "zebrafinken")) == 1
    assert X.files_of_term(spark, store, "no such text at all") == []
    assert X.search_stored(spark, store, "no such text at all").isEmpty()
    assert len(X.files_of_term(spark, store, "ze")) == len(X.files_of_term(spark, store, "")) == total
    model = load_table(spark, store).first()["model"]
    holding = load_table(spark, store).filter(F.lower("model").contains(model.lower())).select("_metadata.file_path").distinct().count()
    assert holding <= len(X.files_of_term(spark, store, model))


def test_index_may_lag(spark, store):
    X.update_text_index(spark, store)
    late = load_table(spark, store).filter("id <> 'rare'").limit(1).drop("day").withColumns({"id": F.lit("late"), "output_message": F.lit("a second zebrafinken")})
    write_requests(spark.createDataFrame(late.collect(), late.schema), store)
    assert ids(X.search_stored(spark, store, "Zebrafinken")) == ["late", "rare"]
    assert X.update_text_index(spark, store) == 1
    assert ids(X.search_stored(spark, store, "Zebrafinken")) == ["late", "rare"]
    assert len(X.files_of_term(spark, store, "zebrafinken")) == 2


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text).encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=6), st.integers(1, 9), st.integers(0, 2))
def test_sequences_by_definition(texts, step, skip):
    want = {int.from_bytes(b[i:i + 3], "big") for t in texts[skip:] if t is not None for b in [folded(t)] for i in range(len(b) - 2)}
    seen = np.zeros(1 << 24, bool)
    whole, X._STEP = X._STEP, step
    try:
        X._mark(seen, pa.array(texts, pa.string()).slice(skip))
    finally:
        X._STEP = whole
    assert set(np.flatnonzero(seen).tolist()) == want
    for t in texts[skip:]:
        assert set(X.sequences((t or "").replace("%", "").replace("_", ""))) <= want or "%" in t or "_" in t


def test_long_text_and_empty_table(spark, store, tmp_path):
    long = "x" * (X._STEP - 1) + "Needle" + "y" * 100
    one = load_table(spark, store).limit(1).drop("day").withColumns({"id": F.lit("long"), "output_message": F.lit(long)})
    path = str(tmp_path / "long")
    write_requests(one, path)
    X.update_text_index(spark, path)
    assert ids(X.search_stored(spark, path, "xneedley")) == ["long"] and X.files_of_term(spark, path, "needlex") == []
    none = str(tmp_path / "none")
    load_table(spark, store).drop("day").limit(0).write.parquet(none)
    X.update_text_index(spark, none)
    assert X.search_stored(spark, none, "needle").isEmpty()
