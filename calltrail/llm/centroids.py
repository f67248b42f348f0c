"""K-means rounds over integer vectors: blocks in Hilbert order with zone maps choose the centroids worth comparing.

Vectors are put in the order of a Hilbert curve and cut into blocks; a block keeps the least and greatest value of each
component (its box). The distances from a centroid to the nearest and to the farthest point of a box bound those to all
vectors of the block, so centroids whose lower bound is above the smallest upper bound are not compared with any of them.
What is left is compared exactly. Blocks are written once; a round reads them and returns sums of each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a block, and bits of a component that take part in the place on the curve.
BLOCK_ROWS, CURVE_BITS = 256, 2
#: Integers beyond it are taken as it: squared distances of 64 components then fit a long.
LIMIT = 1 << 27
# Products of values up to this size are summed exactly by floating-point matrix products.
_EXACT = 1 << 20


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Integer components of a list column without NULLs, one row a vector."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(np.clip(scale * values, -LIMIT, LIMIT)).astype(np.int64)


def hilbert_keys(levels: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``levels`` (values below 2**bits) on a Hilbert curve, as bytes in the curve's order.

    Skilling's transform (2004): undo the rotations from the highest bit downwards, then Gray-encode across components.
    """
    x = levels.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            flip = (x[i] & np.uint32(q)) != 0
            swap = np.where(flip, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    spread = np.concatenate([((x >> np.uint32(b)) & np.uint32(1)).T for b in range(bits - 1, -1, -1)], 1)
    return [row.tobytes() for row in np.packbits(spread.astype(np.uint8), axis=1)]


def _spread(dims: int, scale: int):
    """Sums of the components of a task's vectors, and of their squares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(dims), np.zeros(dims), 0
        for batch in batches:
            m = _matrix(batch.column(0), dims, scale).astype(np.float64)
            total, squares, n = total + m.sum(0), squares + (m * m).sum(0), n + len(m)
        yield pa.record_batch({"dim": pa.array(np.arange(dims), pa.int32()), "total": pa.array(total), "squares": pa.array(squares), "n": pa.array([n] * dims, pa.int64())})
    return run


def _placed(mean: np.ndarray, deviation: np.ndarray, dims: int, scale: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), dims, scale)
            levels = np.clip(np.floor((m - mean) / deviation + (1 << bits) / 2), 0, (1 << bits) - 1)
            rows = m.astype("<i4")
            yield pa.record_batch({"vec_id": batch.column(0), "spot": pa.array(hilbert_keys(levels, bits), pa.binary()), "v": pa.array([r.tobytes() for r in rows], pa.binary())})
    return run


def _blocks(block_rows: int, dims: int):
    """Consecutive vectors as blocks with their boxes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                m = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dims)
                yield pa.record_batch({"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([m.tobytes()], pa.binary()),
                                       "low": pa.array([m.min(0).tobytes()], pa.binary()), "high": pa.array([m.max(0).tobytes()], pa.binary())})
    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box ``low`` to ``high``, ascending."""
    near = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(m: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``numbers`` to each row and its squared distance; the smaller number wins ties."""
    some = centroids[numbers]
    if max(np.abs(m).max(initial=0), np.abs(some).max(initial=0)) <= _EXACT:
        a, b = m.astype(np.float64), some.astype(np.float64)
        d = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    else:
        d = np.stack([((m - c) ** 2).sum(1) for c in some], 1)
    at = d.argmin(1)
    return numbers[at], d[np.arange(len(m)), at]


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    dims = centroids.shape[1]
    for ids, raw, low, high in zip(*(batch.column(k).to_pylist() for k in ("ids", "vectors", "low", "high"))):
        m = np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)
        box = [np.frombuffer(x, "<i4").astype(np.int64) for x in (low, high)]
        yield ids, m, *nearest(m, centroids, candidates(*box, centroids))


def _sums(centroids: np.ndarray):
    """Number and component sums of the vectors that a task assigns to each centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            for _, m, number, _ in _assigned(batch, centroids):
                count += np.bincount(number, minlength=len(centroids))
                np.add.at(total, number, m)
        some = np.flatnonzero(count)
        yield pa.record_batch({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]), "totals": pa.array(total[some].tolist(), pa.list_(pa.int64()))})
    return run


def _rows(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, number, distance in _assigned(batch, centroids):
                yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(number.astype(np.int32)), "distance": pa.array(distance)})
    return run


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors, unchanged without any. Only clusters x components figures come back."""
    partial = blocks.mapInArrow(_sums(centroids), "cluster int, n long, totals array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = partial.select("cluster", "n", F.posexplode("totals").alias("dim", "total")).groupBy("cluster", "dim").agg(exact("n").alias("n"), exact("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
                    scale: int = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row of ``vectors``.

    Kept are vectors of exactly ``dims`` components without NULL, NaN or infinity; a component x becomes
    floor(scale * x). The ``k`` kept rows with the smallest sha256 of ``seed:id`` are the first centroids. Each round
    assigns every vector to the nearest centroid (squared distance, smaller number on ties) and moves centroids to the
    floor of the mean; after ``rounds`` rounds vectors are assigned once more.

    Cases: fewer than ``k`` vectors give as many centroids; rows that share an id are vectors of their own, and seeds of
    equal hashes go by their components; a NULL id is kept and comes after all others as a seed; integers beyond
    2**27 either way count as 2**27, since squared distances must fit a long; sums beyond a long are NULL; an empty table
    or one without kept vectors gives no rows. Other columns are not looked at.

    Equal vectors in any number spread over blocks and tasks: the range partitioning goes on by a hash behind the curve.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    slim = slim.filter((F.size("v") == dims) & F.forall("v", finite))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = slim.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return _no_rows(spark)
    centroids = np.array([_matrix(pa.array([r["v"]], pa.list_(pa.float64())), dims, scale)[0] for r in first])
    figures = slim.select("v").mapInArrow(_spread(dims, scale), "dim int, total double, squares double, n long").groupBy("dim").agg(
        F.sum("total").alias("t"), F.sum("squares").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    mean = np.array([r["t"] / r["n"] for r in figures])
    deviation = np.sqrt(np.maximum([r["s"] / r["n"] for r in figures] - mean * mean, 1.0))
    placed = slim.mapInArrow(_placed(mean, deviation, dims, scale, CURVE_BITS), "vec_id long, spot binary, v binary").withColumn(
        "salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    ordered = placed.repartitionByRange("spot", "salt").sortWithinPartitions("spot", "salt").select("vec_id", "v")
    blocks = written(ordered.mapInArrow(_blocks(block_rows, dims), "ids array<long>, vectors binary, low binary, high binary"), "blocks")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)
    found = written(blocks.mapInArrow(_rows(centroids), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    stats = [(c, fits(d), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    # At most k rows.
    table = F.broadcast(spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    return f"""
near{n} AS MATERIALIZED (
  SELECT r, arg_min(cluster, d * {K} + cluster) AS cluster, min(d) AS distance
  FROM (SELECT k.r, c.cluster, (k.vv + c.cc - 2 * list_inner_product(k.v, c.v))::HUGEINT AS d FROM kept k, cents{n} c) GROUP BY r)"""


def _move_sql(n: int) -> str:
    return f"""
cents{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v, list_inner_product(coalesce(m.v, c.v), coalesce(m.v, c.v)) AS cc
  FROM cents{n} c LEFT JOIN (
    SELECT cluster, list((CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END)::DOUBLE ORDER BY i) AS v
    FROM (SELECT cluster, i, sum(x::HUGEINT) AS s, count(*) AS n FROM (
      SELECT a.cluster, unnest(range(1, {DIMS + 1})) AS i, unnest(k.v) AS x FROM near{n} a JOIN kept k ON a.r = k.r) GROUP BY cluster, i)
    GROUP BY cluster) m ON c.cluster = m.cluster)"""


CLUSTERS_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT *, list_inner_product(v, v) AS vv FROM (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})),
cents0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v, vv AS cc
  FROM (SELECT v, vv, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {K})),
{",".join(_round_sql(n) + "," + _move_sql(n) for n in range(ROUNDS))},
{_round_sql(ROUNDS)}
SELECT k.vec_id, a.cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near{ROUNDS} a JOIN kept k ON a.r = k.r JOIN cents{ROUNDS} c ON a.cluster = c.cluster
"""
