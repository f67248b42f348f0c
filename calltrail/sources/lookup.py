"""Lookups in a stored request table through an index of keys to files, without a scan of the log.

The index lies below the table, in ``_keys``, which readers of the table do not see: ``batch=N/part`` has a row (column,
hash, file) for each distinct key of each file, sorted by column and hash, ``batch=N/files`` names the files it covers and
is written last. It may lag behind: files that no batch names are read whole, files that are gone are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import lookup_requests
from .rewrites import _there
from .tables import LOOKUP_COLUMNS, load_table

#: Up to so many keys go into the condition that files are read with, where Bloom filters skip row groups; more are joined.
FEW = 500


def _inside(file: str, store: str) -> str:
    """Path of a file below the table, the same whatever way the path of the table is spelled."""
    name = store.rstrip("/").rsplit("/", 1)[-1]
    return file[file.rindex(f"/{name}/") + len(name) + 2:]


def _files(spark: SparkSession, store: str) -> dict[str, str]:
    return {_inside(f, store): f for f in load_table(spark, store).inputFiles()}


def _index(spark: SparkSession, store: str, name: str = "_keys") -> tuple[list[int], set[str]]:
    """Numbers of the finished batches of the index ``name``, and the files they cover."""
    home = f"{store.rstrip('/')}/{name}"
    done = []
    while _there(spark, f"{home}/batch={len(done)}/files/_SUCCESS"):
        done.append(len(done))
    if not done:
        return [], set()
    names = spark.read.schema("file string").parquet(*[f"{home}/batch={n}/files" for n in done])
    return done, {r["file"] for r in names.collect()}


def update_index(spark: SparkSession, store: str, columns: tuple[str, ...] = LOOKUP_COLUMNS) -> int:
    """Index the files that no batch covers yet, as one batch more; how many those were. One writer at a time.

    Only key columns are read. A key that fills many files gives one row a file: distinct keys of a file are found by
    partial aggregation, and rows are dealt by ranges of (column, hash, file), so no key meets in one task.
    """
    done, covered = _index(spark, store)
    new = {k: f for k, f in _files(spark, store).items() if k not in covered}
    if not new:
        return 0
    home = f"{store.rstrip('/')}/_keys/batch={len(done)}"
    log = spark.read.schema(load_table(spark, store).schema).option("basePath", store).parquet(*new.values())
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("key")) for c in columns]))
    keys = log.select(F.col("_metadata.file_path").alias("path"), *columns).select("path", cells).filter("key IS NOT NULL AND key <> ''")
    name = store.rstrip("/").rsplit("/", 1)[-1]
    rows = keys.select("column", F.xxhash64("key").alias("hash"), F.element_at(F.split("path", f"/{_quoted(name)}/"), -1).alias("file")).distinct()
    (rows.repartitionByRange("column", "hash", "file").sortWithinPartitions("column", "hash", "file")
     .write.mode("overwrite").parquet(f"{home}/part"))
    spark.createDataFrame([(f,) for f in new], "file string").write.mode("overwrite").parquet(f"{home}/files")
    return len(new)


def _quoted(text: str) -> str:
    return f"\\Q{text}\\E"


def files_with(spark: SparkSession, store: str, column: str, keys: DataFrame, key: str = "key") -> list[str]:
    """Files of the table that may hold one of the keys. File names, not rows, come to the driver."""
    current = _files(spark, store)
    done, covered = _index(spark, store)
    chosen = {f for f in current if f not in covered}
    if done:
        index = spark.read.schema("column string, hash long, file string").parquet(*[f"{store.rstrip('/')}/_keys/batch={n}/part" for n in done])
        wanted = keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("hash")).distinct()
        few = [r["hash"] for r in wanted.limit(FEW + 1).collect()]
        hits = index.filter(F.col("column") == column)
        hits = hits.filter(F.col("hash").isin(few)) if len(few) <= FEW else hits.join(wanted, "hash", "left_semi")
        chosen |= {r["file"] for r in hits.select("file").distinct().collect()} & set(current)
    return [current[f] for f in sorted(chosen)]


def _read(spark: SparkSession, store: str, files: list[str]) -> DataFrame:
    schema = load_table(spark, store).schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", store).parquet(*files)


def rows_with(spark: SparkSession, store: str, column: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the table at ``store`` whose ``column`` (one of the indexed) is among ``keys``: those of ids, spans, traces or conversations.

    Cases: NULL and empty keys find nothing; repeated keys find a row once; a key that no row has finds nothing; without an
    index, and in files it does not cover, the whole files are read, so the rows are the same.
    """
    wanted = keys.select(F.col(key).alias(column)).filter(F.col(column) != "").distinct()
    rows = _read(spark, store, files_with(spark, store, column, keys, key))
    few = [r[0] for r in wanted.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return rows.filter(F.col(column).isin(few))
    return rows.join(wanted, column, "left_semi").select(rows.columns)


def find_requests(spark: SparkSession, store: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows for a table of keys: by id, else by span id, as :func:`~calltrail.operators.filters.lookup_requests` over the whole table."""
    files = sorted({f for c in ("id", "span_id") for f in files_with(spark, store, c, keys, key)})
    rows = _read(spark, store, files)
    few = [r[0] for r in keys.select(key).distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        named = [v for v in few if v is not None]
        rows = rows.filter(reduce(Column.__or__, [F.col(c).isin(named) for c in ("id", "span_id")]))
    return lookup_requests(rows, keys, key)
