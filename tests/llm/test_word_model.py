"""The word model against its definition, with each trigram taken out of one text."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from calltrail.llm.quality import quality
from calltrail.llm.word_model import left_out_probabilities

SCHEMA = "lang string, a long, b long, c long"


def discounts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
    return [k / 2 if y is None or not n[k] else min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]


def smoothed(counts, key, d, lower):
    """Interpolated probability of ``key`` among the counts of its context."""
    total = sum(counts.values())
    if not total:
        return lower
    cut = lambda c: 0 if c == 0 else d[min(c, 3) - 1]
    c = counts.get(key, 0)
    return (c - cut(c) + sum(cut(x) for x in counts.values()) * lower) / total


def plain(rows):
    """lp of every (a, b, c): all lower counts are made anew without one count of the trigram."""
    whole = Counter(rows)

    def tables(types):
        pairs, singles = defaultdict(set), defaultdict(set)
        for a, b, c in types:
            pairs[b, c].add(a)
        pairs = {k: len(v) for k, v in pairs.items()}
        for b, c in pairs:
            singles[c].add(b)
        return pairs, {c: len(v) for c, v in singles.items()}

    pairs, singles = tables(whole)
    d3, d2, d1 = discounts(whole.values()), discounts(pairs.values()), discounts(singles.values())
    out = {}
    for a, b, c in whole:
        types = whole - Counter([(a, b, c)])
        pairs, singles = tables(types)
        p = smoothed(singles, c, d1, 1 / (len(singles) + 1))
        p = smoothed({z: n for (y, z), n in pairs.items() if y == b}, c, d2, p)
        out[a, b, c] = math.log(smoothed({z: n for (x, y, z), n in types.items() if (x, y) == (a, b)}, c, d3, p))
    return out


@pytest.mark.parametrize("seed, size, words", [(1, 400, 6), (2, 60, 4), (3, 900, 12), (4, 1, 3)])
def test_left_out_probabilities_by_definition(spark, seed, size, words):
    rng = random.Random(seed)
    draw = lambda: min(int(rng.expovariate(0.4)), words)
    data = {lang: [(draw(), draw(), draw()) for _ in range(size)] for lang in ("x", "")}
    df = spark.createDataFrame([(lang, *t) for lang, rows in data.items() for t in rows], SCHEMA)
    got = {(r["lang"], r["a"], r["b"], r["c"]): r["lp"] for r in left_out_probabilities(df).collect()}
    want = {(lang, *t): lp for lang, rows in data.items() for t, lp in plain(rows).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_verdicts_of_missing_languages_and_lone_documents(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["sun", "moon", "star", "sky", "cloud", "rain", "wind"]) + str(rng.randrange(4)) for _ in range(80))
    rows = [(i, text(), None) for i in range(20)] + [(100, text(), "only"), (101, None, "none"), (102, "few words", "few"), (103, "- " * 90 + " ".join(f"- {i} =" for i in range(60)), None)]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert got[100]["kept"] and got[100]["low"] <= got[100]["log_perplexity"] <= got[100]["high"]
    assert not got[101]["kept"] and not got[102]["kept"] and got[101]["base_failed"] and got[102]["base_failed"]
    assert sum(got[i]["kept"] for i in range(20)) >= 17
