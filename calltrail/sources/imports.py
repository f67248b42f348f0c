"""Import of call records from JSON files (A5)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, is_json, once, with_member
from ..functions.messages import parse_created_at
from ..operators.evaluation import BAD, text_fields
from ..scale import BLOCK
from ..schema import REQUESTS

IMPORTED_TAG = "imported"


# Names of files with one record per line, and what compressed files add to their names.
LINE_NAMES, PACKED = ("jsonl", "ndjson"), ("gz", "bz2", "zst", "lz4", "snappy", "deflate")


def read_records(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """(seq, value): one JSON record text per row, from a file or a folder of files.

    With ``lines`` every line is a record; files are split and read in parallel,
    the form for large imports. Without it each file decides by its name, less a
    compression suffix: ``.jsonl`` and ``.ndjson`` hold lines, others one JSON
    array or object, which a single task must read whole. A file of the second
    kind that is no single JSON value is taken by line too, so that nothing is
    left out.
    """
    def by_line(names: Column | None) -> DataFrame:
        read = spark.read.text(path)
        read = read if names is None else read.filter(names)
        return read.filter(F.trim("value") != "").select("value")

    def whole(names: Column | None) -> DataFrame:
        docs = spark.read.text(path, wholetext=True)
        docs = docs if names is None else docs.filter(~names)
        parts = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
        listed = F.coalesce(F.from_json("value", "array<string>"), parts)
        items = F.when(~is_json("value"), parts).when(F.ltrim("value").startswith("["), listed).otherwise(F.array("value"))
        return docs.select(F.explode(items).alias("value"))

    if lines is None:
        # One predicate parts the files; Spark applies it to the list of files, so none is read twice.
        of_lines = F.lower("_metadata.file_name").rlike(rf"\.({'|'.join(LINE_NAMES)})(\.({'|'.join(PACKED)}))?$")
        records = by_line(of_lines).unionAll(whole(of_lines))
    else:
        records = by_line(None) if lines else whole(None)
    return records.select(F.monotonically_increasing_id().alias("seq"), "value")


def _uuid_from(*parts: Column) -> Column:
    """An id that a recomputed task would give again (unlike ``uuid()``)."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, 21, 12))


def _number(name: str) -> Column:
    return F.coalesce(F.col(f"r.{name}").try_cast("double"), F.lit(0.0))


def _document(name: str, openers: str) -> Column:
    """A field that holds a JSON array or object (or the text of one), else NULL."""
    text = blank_to_null(F.col(f"r.{name}"))
    return F.when(F.substring(F.ltrim(text), 1, 1).isin(*openers) & is_json(text), text)


def _block() -> Column:
    return F.floor(F.col("seq") / F.lit(BLOCK))


def _first_of_id(typed: DataFrame) -> DataFrame:
    """One row of each id, the one with the smallest ``seq``, without ``seq``.

    Rows are dealt out by (id, block of positions) before the first ranking: a task that reads files passes them on
    and keeps none, and an id that fills a large part of the file comes in many parts.
    """
    rows = typed.withColumn("_block", _block()).repartition("id", "_block")
    for keys in (["id", "_block"], ["id"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
        rows = rows.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth")
    return rows.drop("_block", "seq")


def _refused(slim: DataFrame, existing: DataFrame | None) -> DataFrame:
    """(seq, id, reason) of the rows (seq, id) that a smaller ``seq`` of their id goes before, and of first rows whose id ``existing`` holds.

    Within (id, block of positions) all rows but the smallest are known as duplicates. The smallest meet by id, with
    the stored ids; the others go along, spread by position, so that records are parsed once.
    """
    least = F.min("seq").over(Window.partitionBy("id", "_block"))
    head = F.col("seq").isNull() | (F.col("seq") == least)
    rows = (slim.withColumn("_block", _block()).withColumn("_head", head)
            .select("seq", "id", F.when(F.col("_head"), F.col("id")).alias("_key"), F.when(~F.col("_head"), F.col("seq")).alias("_spread"), F.lit(False).alias("_stored")))
    if existing is not None:
        stored = existing.select(F.col("id").cast("string").alias("id")).filter("id IS NOT NULL")
        rows = rows.unionByName(stored.select("id", F.col("id").alias("_key"), F.lit(True).alias("_stored")), allowMissingColumns=True)
    # One order for all three, so that a task sorts its rows once.
    order = Window.partitionBy("_key", "_spread").orderBy("_stored", "seq")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_least": F.min("seq").over(group), "_known": F.max("_stored").over(group), "_nth": F.row_number().over(order)})
    # A record without a position never comes first, though it may be the one that is taken.
    duplicate = F.col("_key").isNull() | F.col("seq").isNull() | (F.col("seq") > F.col("_least"))
    known = F.col("_key").isNotNull() & F.col("_known") & (F.col("_nth") == 1)
    reasons = F.array_compact(F.array(F.when(duplicate, F.lit("duplicate id")), F.when(known, F.lit("id exists"))))
    return rows.filter(~F.col("_stored")).select("seq", "id", F.explode(reasons).alias("reason"))


def import_records(records: DataFrame, existing: DataFrame | None = None, now: Column | None = None,
                   import_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(request rows, rejects with seq, id and reason) from rows (seq, value).

    Of several records with one id the first is taken; an id that ``existing``
    holds is rejected. Both are found block by block of positions before rows
    meet by id, so an id repeated in a large part of the file does no harm, and
    no task holds more than its share of a shuffle, however many records it
    reads. Ids are made for records without one from ``import_id``, position and
    text.
    """
    now = F.current_timestamp() if now is None else now
    names = tuple(f.name for f in REQUESTS) + ("cost",)
    rows = once(records.select("seq", "value"), r=text_fields("value", names))
    readable = F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull() & is_json("value")
    unreadable = rows.filter(~readable).select("seq", F.lit(None).cast("string").alias("id"), F.lit("not a JSON object").alias("reason"))
    rows = once(rows.filter(readable),
                _id=F.coalesce(blank_to_null(F.col("r.id")), _uuid_from(F.lit(import_id), F.col("seq").cast("string"), F.col("value"))),
                _model=F.coalesce(blank_to_null(F.col("r.model")), F.lit("unknown")),
                _prompt=_number("prompt_tokens").cast("long"), _completion=_number("completion_tokens").cast("long"),
                _in=_document("input_messages", "[{"), _out=_document("output_message", "[{"), _meta=_document("metadata", "{"),
                _tags=F.coalesce(F.from_json(_document("tags", "["), "array<string>"), F.array().cast("array<string>")))
    model = F.col("_model")
    total = F.coalesce(F.nullif(_number("total_tokens").cast("long"), F.lit(0)), F.col("_prompt") + F.col("_completion"))
    cost = F.coalesce(F.nullif(_number("estimated_cost"), F.lit(0.0)), _number("cost"))
    metadata = F.when(F.col("_meta").isNull(), F.lit('{"imported":true}')).otherwise(with_member("_meta", IMPORTED_TAG, "true"))
    tags = F.when(F.array_contains("_tags", IMPORTED_TAG), F.col("_tags")).otherwise(F.array_append("_tags", IMPORTED_TAG))
    given = {
        "id": F.col("_id"), "model": model, "provider": F.coalesce(blank_to_null(F.col("r.provider")), F.lit("imported")),
        "input_messages": F.coalesce("_in", F.lit("[]")), "output_message": F.col("_out"),
        "prompt_tokens": F.col("_prompt"), "completion_tokens": F.col("_completion"), "total_tokens": total,
        "estimated_cost": cost, "latency_ms": _number("latency_ms").cast("long"),
        "status": F.coalesce(blank_to_null(F.col("r.status")), F.lit("success")), "metadata": metadata, "tags": F.to_json(tags),
        "stream": F.coalesce(F.col("r.stream").isin("true", "1"), F.lit(False)),
        "span_id": F.coalesce(blank_to_null(F.col("r.span_id")), F.col("_id")),
        "span_name": F.coalesce(blank_to_null(F.col("r.span_name")), F.concat(F.lit("Imported - "), model)),
        "span_type": F.coalesce(blank_to_null(F.col("r.span_type")), F.lit("llm")),
        "created_at": F.coalesce(parse_created_at("r.created_at"), now)}

    def column(field) -> Column:
        c = given.get(field.name)
        return (blank_to_null(F.col(f"r.{field.name}")) if c is None else c).try_cast(field.dataType).alias(field.name)

    typed = rows.select("seq", *[column(f) for f in REQUESTS])
    first = _first_of_id(typed)
    if existing is not None:
        first = first.join(existing.select("id"), "id", "left_anti")
    return first.select(*[f.name for f in REQUESTS]), unreadable.unionByName(_refused(typed.select("seq", "id"), existing))


def import_logs(spark: SparkSession, path: str, existing: DataFrame | None = None, lines: bool | None = None,
                import_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Import files; every import makes new ids for records without one, unless ``import_id`` repeats an earlier import."""
    return import_records(read_records(spark, path, lines), existing, import_id=import_id or uuid.uuid4().hex)
