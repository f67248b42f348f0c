"""Filters, lookups and paging over the call table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import ColumnLike, as_col

# Page sizes (largest, default) and columns a page may be sorted by.
PAGE_LIMITS = {"requests": (500, 50), "conversations": (200, 50), "traces": (100, 20)}
SORT_COLUMNS = ("created_at", "model", "total_tokens", "estimated_cost", "latency_ms", "status")
PAGE_ORDER = {"conversations": ("last_message_at", "id"), "traces": ("last_span_at", "trace_id")}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRESET_DAYS = {"7d": 6, "30d": 29, "90d": 89}


def contains_folded(column: ColumnLike, term: str) -> Column:
    """Substring, with A-Z and a-z alike; ``%`` and ``_`` in the term act as wildcards, a backslash is itself."""
    folded = "".join(c.lower() if c.isascii() else c for c in term).replace("\\", "\\\\")
    return F.translate(as_col(column), UPPER, UPPER.lower()).like(f"%{folded}%")


def search_requests(requests: DataFrame, term: str) -> DataFrame:
    return requests.filter(contains_folded("input_messages", term) | contains_folded("output_message", term)
                           | contains_folded("model", term))


def feedback_filter(requests: DataFrame, kind: str) -> DataFrame:
    wanted = {"positive": 1, "negative": -1}.get(kind)
    if wanted is None:
        return requests
    return requests.filter(F.get_json_object("feedback", "$.score").try_cast("double") == F.lit(wanted))


def eval_score_range(requests: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    score = F.get_json_object("evaluation", "$.score").try_cast("double")
    if low is not None:
        requests = requests.filter(score >= F.lit(float(low)))
    if high is not None:
        requests = requests.filter(score <= F.lit(float(high)))
    return requests


def between(requests: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose ``created_at`` lies in ``[start, end]``, both ends included.

    A table stored by ``day`` is also filtered by it, so that only folders of those days are opened.
    """
    by_day = "day" in requests.columns
    if start is not None:
        first = F.lit(start).cast("timestamp")
        requests = requests.filter(F.col("created_at") >= first)
        requests = requests.filter(F.col("day") >= first.cast("date")) if by_day else requests
    if end is not None:
        last = F.lit(end).cast("timestamp")
        requests = requests.filter(F.col("created_at") <= last)
        requests = requests.filter(F.col("day") <= last.cast("date")) if by_day else requests
    return requests


def filter_requests(requests: DataFrame, *, model: str | None = None, status: str | None = None, start=None,
                    end=None, user_id: str | None = None, min_cost: float | None = None,
                    max_cost: float | None = None, search: str | None = None, feedback: str | None = None,
                    min_eval: float | None = None, max_eval: float | None = None) -> DataFrame:
    """All given predicates together; absent ones add nothing to the plan."""
    out = between(requests, start, end)
    for name, value in (("model", model), ("status", status), ("user_id", user_id)):
        if value:
            out = out.filter(F.col(name) == F.lit(value))
    if min_cost is not None:
        out = out.filter(F.col("estimated_cost") >= F.lit(float(min_cost)))
    if max_cost is not None:
        out = out.filter(F.col("estimated_cost") <= F.lit(float(max_cost)))
    if search:
        out = search_requests(out, search)
    if feedback:
        out = feedback_filter(out, feedback)
    return eval_score_range(out, min_eval, max_eval)


def search_conversations(conversations: DataFrame, term: str) -> DataFrame:
    hit = contains_folded("id", term)
    if "title" in conversations.columns:
        hit = hit | contains_folded("title", term)
    return conversations.filter(hit)


def lookup_requests(requests: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows for a table of keys: by id, else by span id (earliest span on a tie)."""
    wanted = keys.select(F.col(key).alias("_key")).distinct()

    def matches(column: str, rank: int) -> DataFrame:
        return (requests.filter(F.col(column).isNotNull()).withColumn("_key", F.col(column))
                .join(wanted, "_key", "left_semi")
                .select("_key", F.struct(F.lit(rank).alias("rank"), "created_at", "id").alias("_order"), F.struct(*requests.columns).alias("_row")))

    both = matches("id", 0).unionByName(matches("span_id", 1))
    best = both.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return best.select(F.col("_key").alias(key), "_row.*")


def resolve_date_range(now: datetime, start: datetime | None = None, end: datetime | None = None,
                       preset: str | None = None) -> tuple[datetime, datetime]:
    """Job parameters: default is the seven days up to ``now``; presets are 24h, 7d, 30d, 90d."""
    if preset == "24h":
        return now - timedelta(hours=24), now
    if preset in PRESET_DAYS:
        first = (now - timedelta(days=PRESET_DAYS[preset])).replace(hour=0, minute=0, second=0, microsecond=0)
        return first, now
    end = end or now
    return start or end - timedelta(days=7), end


def _page_order(kind: str, sort_by: str | None, sort_order: str | None) -> tuple[list[Column], str, str, bool]:
    if kind in PAGE_ORDER:
        column, tie = PAGE_ORDER[kind]
        rising = False
    else:
        column, tie = (sort_by if sort_by in SORT_COLUMNS else "created_at"), "id"
        rising = str(sort_order or "").upper() == "ASC"
    order = [F.col(column).asc(), F.col(tie).asc()] if rising else [F.col(column).desc(), F.col(tie).desc()]
    return order, column, tie, rising


def page(df: DataFrame, page: int = 1, limit: int | None = None, sort_by: str | None = None,
         sort_order: str | None = None, kind: str = "requests") -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with total, page, limit, total_pages).

    The totals are a lazy frame, so asking for a page runs no job by itself.
    For pages far into a large table use :func:`page_after`.
    """
    largest, default = PAGE_LIMITS[kind]
    limit = min(largest, max(1, limit or default))
    page = max(1, page or 1)
    order, *_ = _page_order(kind, sort_by, sort_order)
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    info = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).cast("long").alias("page"), F.lit(limit).cast("long").alias("limit"),
        F.ceil(F.col("total") / limit).cast("long").alias("total_pages"))
    return rows, info


def _within(limit: int, largest: int) -> int:
    """A page of rows has no column for its limit, so a larger one is an error here."""
    if limit > largest:
        raise ValueError(f"limit is {largest} rows at most")
    return max(1, limit)


def page_after(df: DataFrame, last_value, last_tie, limit: int | None = None, sort_by: str | None = None,
               sort_order: str | None = None, kind: str = "requests") -> DataFrame:
    """Page following the row (last_value, last_tie): cost does not grow with depth."""
    largest, default = PAGE_LIMITS[kind]
    limit = _within(limit or default, largest)
    order, column, tie, rising = _page_order(kind, sort_by, sort_order)
    value, tie_value = F.lit(last_value), F.lit(last_tie)
    if rising:
        later = (F.col(column) > value) | ((F.col(column) == value) & (F.col(tie) > tie_value))
    else:
        later = (F.col(column) < value) | ((F.col(column) == value) & (F.col(tie) < tie_value))
    return df.filter(later).orderBy(*order).limit(limit)


def recent_requests(requests: DataFrame, n: int = 5) -> DataFrame:
    return requests.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
