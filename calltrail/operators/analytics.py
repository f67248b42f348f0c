"""Dashboard reports.

All of them are one scan, one filter that reaches the parquet reader and one
aggregation with map-side partial results, so a hot model, user or day costs no
more than one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import js_round
from .filters import between

DAY = "yyyy-MM-dd"
HOUR = "yyyy-MM-dd'T'HH':00:00'"


def day_text(column: str = "created_at") -> Column:
    return F.date_format(column, DAY)


def bucket_text(granularity: str = "daily", column: str = "created_at") -> Column:
    return F.date_format(column, HOUR if granularity == "hourly" else DAY)


def is_error() -> Column:
    return F.col("status") == "error"


def sum0(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def cost0(column: str | Column = "estimated_cost") -> Column:
    """Published cost: a sum rounded to six places."""
    return F.round(F.coalesce(F.sum(column), F.lit(0.0)), 6)


def as_time(value) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def previous_window(start, end) -> tuple[datetime, datetime]:
    """The window of equal length that ends one millisecond before ``start``."""
    s, e = as_time(start), as_time(end)
    prev_end = s - timedelta(milliseconds=1)
    return prev_end - (e - s), prev_end


def pct_change(cur: Column, prev: Column) -> Column:
    growth = (cur - prev) / prev * F.lit(100.0)
    return js_round(F.when(prev == 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(growth), 2)


def overview(requests: DataFrame, start, end) -> DataFrame:
    """Headline figures with change against the previous window, in one scan over both."""
    s, e = as_time(start), as_time(end)
    prev_start, prev_end = previous_window(s, e)
    now = F.col("created_at") >= F.lit(s).cast("timestamp")
    before = F.col("created_at") <= F.lit(prev_end).cast("timestamp")

    def within(column: str) -> Column:
        return F.when(now, F.col(column))

    sums = between(requests, prev_start, e).agg(
        F.count_if(now).alias("n"), F.count_if(before).alias("n_prev"),
        cost0(within("estimated_cost")).alias("cost"),
        F.round(F.coalesce(F.sum(F.when(before, F.col("estimated_cost"))), F.lit(0.0)), 6).alias("cost_prev"),
        F.coalesce(F.avg(within("latency_ms")), F.lit(0.0)).alias("latency"),
        F.count_if(now & is_error()).alias("errors"),
        sum0(within("total_tokens")).alias("total_tokens"),
        sum0(within("prompt_tokens")).alias("total_prompt_tokens"),
        sum0(within("completion_tokens")).alias("total_completion_tokens"))
    rate = F.when(F.col("n") > 0, F.col("errors") / F.col("n") * F.lit(100.0)).otherwise(F.lit(0.0))
    return sums.select(
        F.col("n").alias("total_requests"), F.col("cost").alias("total_cost"),
        js_round("latency").alias("avg_latency"), js_round(rate, 2).alias("error_rate"),
        "total_tokens", "total_prompt_tokens", "total_completion_tokens",
        pct_change(F.col("n"), F.col("n_prev")).alias("requests_change"),
        pct_change(F.col("cost"), F.col("cost_prev")).alias("cost_change"))


def cost_over_time(requests: DataFrame, start, end, granularity: str = "daily") -> DataFrame:
    return (between(requests, start, end)
            .groupBy(bucket_text(granularity).alias("date"), "model")
            .agg(cost0().alias("cost")).orderBy("date", "model"))


def token_usage(requests: DataFrame, start, end) -> DataFrame:
    return (between(requests, start, end).groupBy(day_text().alias("date"))
            .agg(sum0("prompt_tokens").alias("prompt_tokens"),
                 sum0("completion_tokens").alias("completion_tokens"),
                 sum0("total_tokens").alias("total_tokens")).orderBy("date"))


def _per_model(requests: DataFrame, start, end) -> DataFrame:
    return (between(requests, start, end).groupBy("model")
            .agg(F.count(F.lit(1)).alias("requests"), cost0().alias("cost"),
                 sum0("total_tokens").alias("tokens"),
                 F.coalesce(F.round(F.avg("latency_ms")), F.lit(0.0)).alias("avg_latency")))


def model_usage(requests: DataFrame, start, end) -> DataFrame:
    return _per_model(requests, start, end).orderBy(F.col("requests").desc(), "model")


def top_models(requests: DataFrame, start, end, n: int = 8) -> DataFrame:
    return (_per_model(requests, start, end).select("model", "requests")
            .orderBy(F.col("requests").desc(), "model").limit(n))


def latency_stats(requests: DataFrame, start, end, exact: bool = True) -> DataFrame:
    """Nearest-rank percentiles per day, errors left out.

    Exact mode first counts equal latencies (partial counts per task), so a day
    reaches the ranking step as its distinct latency values, not as its rows.
    """
    ok = between(requests, start, end).filter(F.col("status") != "error").select(
        day_text().alias("date"), "latency_ms")
    if not exact:
        marks = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10_000)
        return (ok.groupBy("date").agg(marks.alias("p"), F.sum("latency_ms").alias("s"), F.count("latency_ms").alias("n"))
                .select("date", F.get("p", 0).alias("p50"), F.get("p", 1).alias("p95"), F.get("p", 2).alias("p99"),
                        js_round(F.col("s") / F.col("n")).alias("avg")).orderBy("date"))
    return latency_percentiles(ok.filter(F.col("latency_ms").isNotNull()).groupBy("date", "latency_ms").agg(F.count(F.lit(1)).alias("n")))


def latency_percentiles(counts: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and rounded average per date from counts of latencies (date, latency_ms, n)."""
    day = Window.partitionBy("date")
    upto = day.orderBy("latency_ms").rangeBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("date", "latency_ms", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(day).alias("all"))

    def rank_at(p: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.lit(p / 100.0) * F.col("all")), F.col("latency_ms")))

    return (ranked.groupBy("date")
            .agg(rank_at(50).alias("p50"), rank_at(95).alias("p95"), rank_at(99).alias("p99"),
                 js_round(F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("avg"))
            .orderBy("date"))


def error_trend(requests: DataFrame, start, end) -> DataFrame:
    return (between(requests, start, end).groupBy(day_text().alias("date"))
            .agg(F.count_if(is_error()).alias("error_count"), F.count(F.lit(1)).alias("total_count"))
            .select("date", "error_count", "total_count",
                    F.round(F.col("error_count") / F.col("total_count") * 100, 2).alias("error_rate"))
            .orderBy("date"))


def top_errors(requests: DataFrame, start, end, n: int = 10) -> DataFrame:
    return (between(requests, start, end).filter(is_error() & F.col("error_message").isNotNull())
            .groupBy("error_message").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "error_message").limit(n))


def user_stats(requests: DataFrame, start, end) -> DataFrame:
    """Per user; rows without a user form one group shown as ``anonymous``."""
    return (between(requests, start, end).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("requests"), cost0().alias("cost"), sum0("total_tokens").alias("tokens"))
            .select(F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), "requests", "cost", "tokens")
            .orderBy(F.col("cost").desc(), "user_id"))


def daily_stats(requests: DataFrame) -> DataFrame:
    """Rollup per (date, model); write it partitioned by ``date`` with dynamic overwrite."""
    return (requests.groupBy(day_text().alias("date"), "model")
            .agg(F.count(F.lit(1)).alias("total_requests"), sum0("total_tokens").alias("total_tokens"),
                 sum0("prompt_tokens").alias("total_prompt_tokens"),
                 sum0("completion_tokens").alias("total_completion_tokens"), cost0().alias("total_cost"),
                 js_round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
                 F.count_if(is_error()).alias("error_count")))


def daily_stats_of(counts: DataFrame) -> DataFrame:
    """As :func:`daily_stats`, from additive counts (date, model, latency_ms, failed, n and totals)."""
    known = F.when(F.col("latency_ms").isNotNull(), F.col("n"))
    average = F.sum(F.col("latency_ms") * F.col("n")) / F.sum(known)
    return (counts.groupBy("date", "model")
            .agg(F.sum("n").alias("total_requests"), F.sum("total_tokens").alias("total_tokens"),
                 F.sum("total_prompt_tokens").alias("total_prompt_tokens"), F.sum("total_completion_tokens").alias("total_completion_tokens"),
                 cost0("total_cost").alias("total_cost"), js_round(F.coalesce(average, F.lit(0.0)), 6).alias("avg_latency_ms"),
                 F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("error_count")))


def write_daily_stats(requests: DataFrame, path: str) -> None:
    """Replace the rollup partitions of the dates present in ``requests``."""
    (daily_stats(requests).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def table_totals(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count(F.lit(1)).alias("total_requests"))


def cost_share(requests: DataFrame, start, end) -> DataFrame:
    """Share of each model in the total cost, one decimal.

    The total is a scalar subquery over the same small aggregate.
    """
    usage = _per_model(requests, start, end).select("model", "requests", "cost")
    total = usage.agg(F.sum("cost").alias("t")).scalar()
    share = F.when(total > 0, F.round(F.col("cost") / total * 100, 1)).otherwise(F.lit(0.0))
    return usage.withColumn("cost_pct", share).orderBy(F.col("requests").desc(), "model")


def tokens_per_request(requests: DataFrame, start, end) -> DataFrame:
    sums = between(requests, start, end).agg(F.count(F.lit(1)).alias("n"), sum0("total_tokens").alias("t"))
    return sums.select(F.when(F.col("n") > 0, js_round(F.col("t") / F.col("n"))).otherwise(F.lit(0.0))
                       .alias("tokens_per_request"))


def gap_fill_daily(df: DataFrame, start, end, date_col: str = "date", value_cols: Sequence[str] = ("cost",)) -> DataFrame:
    """One row per calendar day of the range; several rows of a day are summed, absent days are 0."""
    spark = df.sparkSession
    first, last = as_time(start).date().isoformat(), as_time(end).date().isoformat()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("_d")
                                 ).select(F.date_format("_d", DAY).alias(date_col))
    sums = df.groupBy(date_col).agg(*[F.sum(c).alias(c) for c in value_cols])
    filled = [F.coalesce(F.col(c), F.lit(0).cast(sums.schema[c].dataType)).alias(c) for c in value_cols]
    return days.join(sums, date_col, "left").select(date_col, *filled).orderBy(date_col)
