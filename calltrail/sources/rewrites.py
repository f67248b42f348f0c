"""Changes written into a stored request table: only partitions that hold a changed id are rewritten."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import merge_changes
from .tables import load_table


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _there(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)


def _mark(spark: SparkSession, path: str) -> None:
    files, target = _place(spark, path)
    files.create(target, True).close()


def _among(df: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    same = reduce(Column.__and__, [df[n].eqNullSafe(keys[n]) for n in names])
    return df.join(F.broadcast(keys), same, "left_semi")


def _pruned(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows whose ``name`` is one of ``values``, NULL included; on a partition column only those folders are opened."""
    hit = F.col(name).isin([v for v in values if v is not None])
    return df.filter(hit | F.col(name).isNull()) if None in values else df.filter(hit)


def apply_changes(spark: SparkSession, store: str, changes: DataFrame, change_id: str, partitions: Sequence[str] = ("day",)) -> DataFrame:
    """Write ``changes`` (see :func:`merge_changes`) into the request table at ``store``; the rejected changes.

    One pass over ids and partition columns finds the partitions that hold a changed id. Their rows are merged into a
    staging folder below ``<store>/_changes/<change_id>``, which readers of the table do not see, and then replace those partitions;
    all other files stay as they are. A partition that loses all its rows is removed.

    ``change_id`` names the change for good: applied again it does nothing, and after a failure it goes on from the staging
    folder, so every row is changed once. One writer at a time may change a table; changed partitions are not read in
    a consistent state while they are replaced.

    ``partitions`` are the table's partition columns, ``("day", "batch")`` for what ``stream_ingest`` writes. Their distinct values, not the rows, come to the driver.
    """
    home = f"{store.rstrip('/')}/_changes/{change_id}"
    log = load_table(spark, store)
    if not _there(spark, f"{home}/_done"):
        if not _there(spark, f"{home}/_staged"):
            changes.write.mode("overwrite").parquet(f"{home}/changes")
            fixed = spark.read.schema(changes.schema).parquet(f"{home}/changes")
            folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
            touched = log.select("id", *partitions, folder).join(fixed.select("id").distinct(), "id", "left_semi").select(*partitions, "folder").distinct()
            touched.write.mode("overwrite").parquet(f"{home}/touched")
            touched = spark.read.schema(touched.schema).parquet(f"{home}/touched")
            days = [r[0] for r in touched.select(partitions[0]).distinct().collect()]
            rows, rejects = merge_changes(_among(_pruned(log, partitions[0], days), touched.select(*partitions).distinct(), partitions), fixed)
            rows.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(f"{home}/rows")
            rejects.write.mode("overwrite").parquet(f"{home}/rejects")
            _mark(spark, f"{home}/_staged")
        staged = spark.read.schema(log.schema).parquet(f"{home}/rows")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(store)
        touched = spark.read.parquet(f"{home}/touched")
        left = staged.select(*partitions).distinct()
        same = reduce(Column.__and__, [touched[n].eqNullSafe(left[n]) for n in partitions])
        for r in touched.join(F.broadcast(left), same, "left_anti").select("folder").distinct().collect():
            files, target = _place(spark, r["folder"])
            files.delete(target, True)
        _mark(spark, f"{home}/_done")
    return spark.read.schema("id string, field string, value string, seq long, reason string").parquet(f"{home}/rejects")
