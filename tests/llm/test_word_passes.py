"""The word model in passes: any plan of cells, numbered and split words gives the probabilities of the definition, in few bytes a trigram."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_word_model import SCHEMA, plain

from calltrail.llm.word_model import _BEGIN, Plan, _grouped, _of_texts, _of_trigrams, _packed, _salt, _surprise
from calltrail.llm.words import mix


def words_of(langs, numbers):
    salts = np.array([_salt(x) for x in langs], np.uint64)
    found = (mix(np.array(numbers, np.uint64))[:, None] ^ salts).ravel()
    return found[np.unique(found >> np.uint64(44), return_index=True)[1]]


@pytest.mark.parametrize("numbered, split", [((), 1), ((0, 2, 3), 3)])
def test_plans_change_no_probability(spark, numbered, split):
    rng = random.Random(8)
    draw = lambda: min(int(rng.expovariate(0.4)), 8)
    data = {lang: [(draw(), draw(), draw()) for _ in range(300)] for lang in ("x", "")}
    words = words_of(data, numbered)
    df = spark.createDataFrame([(lang, *t) for lang, rows in data.items() for t in rows], SCHEMA)
    rows = df.select(F.xxhash64("lang", "a", "b", "c").alias("key"), "lang", "a", "b", "c")
    scores = _surprise(rows, _of_trigrams, Plan(7, words, np.full(len(words), split, np.int64)))
    got = {(r["lang"], r["a"], r["b"], r["c"]): -r["surprise"] / r["n_grams"] for r in rows.distinct().join(scores, "key").collect()}
    want = {(lang, *t): lp for lang, rows in data.items() for t, lp in plain(rows).items()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_passes_part_the_trigrams_and_pack_them():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(40)] + ["- - - =", "", None]
    batch = pa.record_batch({"key": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "lang": pa.array(["x"] * len(texts))})
    (_, _, owner, _, (_, last, _)), = _of_texts(batch)
    found = np.unique(last(np.arange(len(owner))))
    plan = Plan(100, found[np.unique(found >> np.uint64(44), return_index=True)[1]], np.ones(len(found), np.int64)[:len(np.unique(found >> np.uint64(44)))])
    passes = [pa.Table.from_batches(_packed(_of_texts, plan, low, low + 20, True)(iter([batch]))) for low in range(0, 100, 20)]
    sizes = [sum(len(x) // 2 for x in t.column("b").to_pylist()) for t in passes]
    assert sum(sizes) == sum(len({(*t,) for t in zip(["", "", *w], ["", *w], w)}) for w in ((x or "").split() for x in texts))
    assert max(sizes) < 0.4 * sum(sizes)
    words = sum(len(x) for t in passes for k in ("a", "b", "c", "rare_a", "rare_b", "rare_c") for x in t.column(k).to_pylist())
    assert words < 8 * sum(sizes)  # hashes of three words are 24 bytes
    weights = np.concatenate([np.frombuffer(x, np.uint32) for t in passes for x in t.column("n").to_pylist()])
    assert weights.sum() == 40 * 400  # signs have no weight
    assert _BEGIN != 0


def test_groups_are_those_of_unique():
    keys = np.array([5, 3, 5, 9, 3, 5], np.uint64)
    at, counts, of = _grouped(keys)
    assert keys[at].tolist() == [3, 5, 9] and counts.tolist() == [2, 3, 1] and keys[at][of].tolist() == keys.tolist()
    assert [len(x) for x in _grouped(keys[:0])] == [0, 0, 0]
