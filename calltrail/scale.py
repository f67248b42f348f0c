"""Order-dependent steps that stay parallel when one key holds most of the rows.

A plain ``row_number`` or ``lag`` window sorts a whole key in one task. The
helpers below cut each key into value-determined blocks (``order div block``),
do the fine work per (key, block), and run the per-key window only over one
summary row per block. ``order`` is an integer column that is unique within a
key, so a block never holds more than ``block`` rows. Blocks depend on values
alone, hence recomputing a lost task gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 50_000


def left_join_sparse(left: DataFrame, right: DataFrame, keys: Sequence[str], sparse: str, spread: str) -> DataFrame:
    """Left join on ``keys`` where ``sparse``, one of them, is NULL in many left rows.

    Such rows match nothing, yet a plain join sends all of them to one task; here
    they are placed by ``spread`` (a column of well-spread values) instead.
    """
    others = [k for k in keys if k != sparse]
    l = left.withColumn("_key", F.coalesce(F.col(sparse).cast("string"), F.col(spread).cast("string"))).withColumn(
        "_real", F.col(sparse).isNotNull())
    r = right.withColumn("_key", F.col(sparse).cast("string")).withColumn("_real", F.lit(True)).drop(sparse)
    return l.join(r, [*others, "_key", "_real"], "left").drop("_key", "_real")


def _block_of(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def number_within(df: DataFrame, keys: Sequence[str], order: str, out: str = "position",
                  block: int = BLOCK) -> DataFrame:
    """1-based position of every row within its key, by ascending ``order``."""
    keys = list(keys)
    blocked = df.withColumn("_block", _block_of(order, block))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (blocked.withColumn("_local", F.row_number().over(inside))
            .join(offsets, [*keys, "_block"])
            .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
            .drop("_block", "_local", "_offset"))


def previous_order(df: DataFrame, keys: Sequence[str], order: str, out: str = "previous",
                   block: int = BLOCK) -> DataFrame:
    """(keys, order, previous order within the key): a ``lag`` that carries only key columns."""
    keys = list(keys)
    slim = df.select(*keys, order).withColumn("_block", _block_of(order, block))
    tops = slim.groupBy(*keys, "_block").agg(F.max(order).alias("_top"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = tops.select(*keys, "_block", F.lag("_top").over(by_block).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (slim.withColumn("_local", F.lag(order).over(inside))
            .join(carried, [*keys, "_block"])
            .select(*keys, order, F.coalesce("_local", "_carried").alias(out)))
