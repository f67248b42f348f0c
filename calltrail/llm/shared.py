"""Tables written to the shared folder of the session, and connected components on edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back: later steps read files that any executor can reach."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter that keeps rows out of a shuffle: 1024 bitmaps of 4 kB at most, whatever the number of keys.
FILTER_BITS = 1 << 25


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind it as it takes to differ from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _marked(df: DataFrame, keys: DataFrame, column: str, bits: int) -> tuple[DataFrame, str]:
    """``df`` with a new last column, and its name: whether ``column`` (a long) may be among the keys; false means it is surely not.

    A one-hash Bloom filter as a table of bitmaps; with its size bound it can be broadcast for any number of keys.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bucket, bitmap, likely = (free_name(df, n) for n in ("_bucket", "_bits", "_likely"))
    maps = (keys.select(place(F.col(column)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bitmap)))
    maps = F.broadcast(written(maps, "filter"))
    spot = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (spot % 8 + 1).cast("int")))
    return (df.withColumn(bucket, F.bitmap_bucket_number(place(F.col(column)))).join(maps, bucket, "left")
            .select(*df.columns, F.coalesce(hit > 0, F.lit(False)).alias(likely))), likely


def split_likely(df: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` may be in ``keys`` (same column name), and those where it surely is not."""
    marked, likely = _marked(df, keys, column, bits)
    return marked.filter(F.col(likely)).drop(likely), marked.filter(~F.col(likely)).drop(likely)


def likely_in(df: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``keys`` (same column name); spares the join that follows the others."""
    return split_likely(df, keys, column, bits)[0]


def without(df: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``keys`` (written, same column name). Only rows that may be go through a shuffle."""
    maybe, surely_not = split_likely(df, keys, column, bits)
    return surely_not.unionAll(maybe.join(keys, column, "left_anti").select(*df.columns))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b longs): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need about log(n) rounds whatever the
    diameter; each round is written to the shared folder. A star's centre may hold any share of the edges: its minimum
    comes from partial aggregation, and the join with it is an equi-join that adaptive execution may split.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every edge now points from the larger to the smaller node.
        lower = large.filter("a <> b")
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = (lower.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b")))).distinct()
        now = written(small, "edges")
        figures = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if figures == state or not figures[0]:
            break
        state = figures
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
