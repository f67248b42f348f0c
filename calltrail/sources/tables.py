"""Stored tables and row defaults (A1, A2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import blank_to_null
from ..functions.messages import parse_created_at
from ..schema import REQUESTS


def _instant(schema: T.StructType) -> T.StructType:
    """Read zone-less timestamps as UTC instants, so that filters still reach the reader."""
    return T.StructType([
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable)
        for f in schema])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_instant(spark.read.parquet(path).schema)).parquet(path)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as a stream of files, whether ``path`` is a folder of parts or one file."""
    reader = spark.readStream.schema(load_table(spark, path).schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


#: Columns by which single rows, traces and conversations are looked up.
LOOKUP_COLUMNS = ("id", "span_id", "trace_id", "conversation_id")


def write_requests(requests: DataFrame, path: str, mode: str = "append") -> None:
    """Store request rows by day. Rebalancing lets AQE split a busy day and merge quiet ones into files of even size.

    Files are sorted by trace and time, so a trace lies in few row groups, and carry Bloom filters of the lookup
    columns, by which a reader with an equality condition skips row groups.
    """
    present = [c for c in LOOKUP_COLUMNS if c in requests.columns]
    order = [c for c in ("trace_id", "created_at", "id") if c in requests.columns]
    by_day = requests.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").sortWithinPartitions("day", *order)
    writer = by_day.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in present:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy("day").parquet(path)


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """``<folder>/<name>.parquet`` for every name."""
    return {n: load_table(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(name)
    return F.col(name).cast("string")


def conform_requests(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Any subset of the request columns to the full layout with its defaults.

    ``now`` stamps rows without ``created_at``.
    """
    present = set(raw.columns)
    now = F.current_timestamp() if now is None else now

    def col(field: T.StructField) -> Column:
        name, kind = field.name, field.dataType
        given = _as_text(raw, name) if isinstance(kind, T.StringType) and name in present else (
            F.col(name) if name in present else F.lit(None))
        if name == "created_at":
            stamp = parse_created_at(given) if name in present and isinstance(raw.schema[name].dataType, T.StringType) else given
            return F.coalesce(stamp.cast("timestamp"), now)
        if name == "provider":
            return F.coalesce(blank_to_null(given), F.lit("deepinfra"))
        if name == "status":
            return F.coalesce(blank_to_null(given), F.lit("success"))
        if name in ("prompt_tokens", "completion_tokens", "total_tokens", "latency_ms"):
            return F.coalesce(given.try_cast("long"), F.lit(0).cast("long"))
        if name == "estimated_cost":
            return F.coalesce(given.try_cast("double"), F.lit(0.0))
        if name == "stream":
            return F.coalesce(given.try_cast("boolean"), F.lit(False))
        if name in ("model", "input_messages"):
            return given.cast("string")
        if isinstance(kind, T.StringType):
            return blank_to_null(given.cast("string"))
        return given.try_cast(kind)

    return raw.select(*[col(f).alias(f.name) for f in REQUESTS])
