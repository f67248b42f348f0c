"""Centroid clustering against a plain version, and its parts against their definitions."""

import hashlib
import math
import random

import numpy as np
import pytest

from calltrail.llm.centroids import candidates, cluster_vectors, hilbert_keys, nearest
from calltrail.llm.shared import written


def plain(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        for n, members in groups.items():
            cents[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, best(v)) for i, v in kept]
    sums = {}
    for _, (d, n) in found:
        sums[n] = sums.get(n, 0) + d
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, (d, n) in found), key=str)


def got(df, **options):
    return sorted(map(tuple, cluster_vectors(df, **options).collect()), key=str)


def test_edge_rows_ties_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.3, 2.0]) for _ in range(4)]) for i in range(300)]
    rows += [(7, [0.0, 0.0, 0.0, 0.0])] * 200 + [(None, [0.5] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]),
                                                 (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1e5, -1e5, 0.0, 0.1]), (906, [])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster string, spot int, salt int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (1, 6, 2000):
        assert got(df, k=k, rounds=3, dims=4, block_rows=16) == plain(rows, k, 3, 4)


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    assert got(df) == [] and got(df.limit(0)) == []


def test_values_beyond_the_limit_count_as_it(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    first = hashlib.sha256
    seed = min((1, 2, 3), key=lambda i: first(f"2:{i}".encode()).hexdigest())
    start = {1: 2 ** 27, 2: -2 ** 27, 3: 0}
    assert {r[0]: r[2] for r in got(df, k=1, rounds=0, dims=1)} == {i: (x - start[seed]) ** 2 for i, x in start.items()}


def test_registered_query_on_given_vectors(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    assert got(table) == plain(rows, 40, 5, 64)


def test_one_vector_holds_half_of_all_rows(spark):
    df = written(spark.range(4000).selectExpr("id AS vec_id", "IF(id % 2 = 0, array(0.1D, 0.2D), array(id / 4000D, -id / 500D)) AS embedding"), "vectors")
    rows = [tuple(r) for r in df.collect()]
    assert got(df, k=5, rounds=2, dims=2, block_rows=32) == plain(rows, 5, 2, 2)


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_never_leave_out_the_nearest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        m, c = rng.integers(-50, 50, (9, 3)) + rng.integers(-200, 200, 3), rng.integers(-200, 200, (12, 3))
        some = candidates(m.min(0), m.max(0), c)
        whole = nearest(m, c, np.arange(12))
        part = nearest(m, c, some)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    big = np.array([[2 ** 27, -2 ** 27]])
    assert nearest(big, -big, np.array([0]))[1][0] == 2 ** 57


def test_boxes_spare_comparisons():
    rng = np.random.default_rng(4)
    cents = rng.integers(-1000, 1000, (40, 2))
    assert len(candidates(np.array([0, 0]), np.array([20, 20]), cents)) < 10
