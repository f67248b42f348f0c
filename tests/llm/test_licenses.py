"""License scans: the aligner against brute force, licenses that differ in a clause or a version, very long texts."""

import random

import pytest

from calltrail.llm import licenses

SCHEMA = "doc_id long, text string"
T = licenses.TEMPLATES


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else row
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_against_common_subsequences(seed):
    """Where no word repeats, patience alignment is a longest common subsequence; else it is a common subsequence."""
    rng = random.Random(seed)
    a, b = rng.sample(range(30), rng.randint(0, 14)), rng.sample(range(30), rng.randint(0, 14))
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) == longest_common(a, b)
    a, b = ([rng.randrange(8) for _ in range(rng.randint(0, 14))] for _ in range(2))
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b) and len(licenses.align(a, a)) == len(a)


def found(spark, rows):
    out = {}
    for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect():
        out.setdefault(r["doc_id"], []).append(r["license"])
    return out


def test_every_template_finds_itself_alone(spark):
    names = list(T)
    assert found(spark, [f"Some words before.\n{T[n]}\nAnd some behind." for n in names]) == {i: [n] for i, n in enumerate(names)}


def test_neighbours_are_told_apart(spark):
    later = T["GPL-3.0-header"]
    assert found(spark, [
        T["BSD-4-Clause"].replace("copyright holder", "organization"),
        later.replace(", or (at your option) any later version", ""),  # neither form
        later.replace("(at your option) any later version", "(at your option) a licence of your own"),
        later.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License"),
        T["GPL-2.0-header"].replace("version 2", "version 1"),
        T["LGPL-2.1-header"].replace("version 2.1", "version 2"),
        T["CC-BY-4.0-notice"].replace("Attribution", "Attribution-NoDerivatives"),
        None, "", "version 3 " * 50,
    ]) == {0: ["BSD-4-Clause"], 3: ["GPL-3.0-only-header"]}


def test_very_long_text(spark):
    filler = "free software of the License version and this is any person to use " * 12000
    text = filler + T["Zlib"] + " " + filler + T["BSD-4-Clause"]
    rows = licenses.find_licenses(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    at = {r["license"]: (r["start"], r["end"]) for r in rows}
    for name in ("Zlib", "BSD-4-Clause"):
        words = T[name].rstrip(".")
        assert at[name] == (text.index(words), text.index(words) + len(words))
