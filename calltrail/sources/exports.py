"""Exports (A6, A7): text files written in parallel, one part per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import blank_to_null, is_json, number_text
from ..operators.filters import filter_requests

# Columns of the CSV export, in order.
CSV_COLUMNS = ("id", "model", "provider", "status", "prompt_tokens", "completion_tokens", "total_tokens",
               "estimated_cost", "latency_ms", "temperature", "max_tokens", "user_id", "stream", "error_message",
               "tags", "feedback", "evaluation", "created_at")


def _cell(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif isinstance(kind, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(requests: DataFrame) -> DataFrame:
    """(created_at, id, value): one CSV line per request."""
    cells = [_cell(requests, c) if c in requests.columns else F.lit("") for c in CSV_COLUMNS]
    return requests.select("created_at", "id", F.concat_ws(",", *cells).alias("value"))


def export_csv(requests: DataFrame, path: str, *, sort_by: str = "created_at", descending: bool = True, **filters) -> None:
    """Filtered rows as CSV parts in sort order. ``<path>/header`` holds the header line, ``<path>/rows`` the data."""
    rows = filter_requests(requests, **filters)
    order = [F.col(sort_by).desc(), F.col("id").desc()] if descending else [F.col(sort_by).asc(), F.col("id").asc()]
    lines = csv_lines(rows.orderBy(*order)).select("value")
    spark = requests.sparkSession
    spark.range(1).select(F.lit(",".join(CSV_COLUMNS)).alias("value")).write.mode("overwrite").text(f"{path}/header")
    lines.write.mode("overwrite").text(f"{path}/rows")


def finetuning_lines(requests: DataFrame) -> DataFrame:
    """(created_at, id, value): ``{"messages":[…inputs, output]}`` per usable request.

    Both documents are valid JSON, so the answer is spliced into the array text;
    keys keep their order and numbers their form.
    """
    inputs, output = F.trim("input_messages"), blank_to_null(F.trim("output_message"))
    usable = (F.coalesce(F.json_array_length(inputs), F.lit(0)) > 0) & is_json(output) & ~output.isin(
        "null", "false", "0", '""')
    value = F.concat(F.lit('{"messages":'), F.regexp_replace(inputs, r"\s*\]$", ""), F.lit(","), output, F.lit("]}"))
    return requests.filter(usable).select("created_at", "id", value.alias("value"))


def export_finetuning(requests: DataFrame, path: str, *, status: str = "success", **filters) -> None:
    rows = filter_requests(requests, status=status, **filters).orderBy(F.col("created_at").desc(), F.col("id").desc())
    finetuning_lines(rows).select("value").write.mode("overwrite").text(path)
