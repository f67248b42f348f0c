"""Retrieval quality of ranked ids against relevant ids (H7 to H9); ids compare as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnLike, as_col, let


def _bound(retrieved: ColumnLike, relevant: ColumnLike, body) -> Column:
    """``body(got, want)`` on both lists as text, converted once per row."""
    both = F.struct(as_col(retrieved).cast("array<string>").alias("got"), as_col(relevant).cast("array<string>").alias("want"))
    return let(both, lambda p: body(p["got"], p["want"]))


def _cut(ids: Column, k: int | None) -> Column:
    return ids if k is None else F.slice(ids, 1, max(k, 0))


def _hits(retrieved: Column, relevant: Column) -> Column:
    return F.size(F.filter(retrieved, lambda x: F.array_contains(relevant, x)))


def recall_at_k(retrieved: ColumnLike, relevant: ColumnLike, k: int | None = None) -> Column:
    def body(got: Column, want: Column) -> Column:
        usable = got.isNotNull() & (F.coalesce(F.size(want), F.lit(0)) > 0)
        return F.when(usable, _hits(_cut(got, k), want) / F.size(want)).otherwise(F.lit(0.0))
    return _bound(retrieved, relevant, body)


def precision_at_k(retrieved: ColumnLike, relevant: ColumnLike, k: int | None = None) -> Column:
    def body(got: Column, want: Column) -> Column:
        cut = _cut(got, k)
        usable = want.isNotNull() & (F.coalesce(F.size(cut), F.lit(0)) > 0)
        return F.when(usable, _hits(cut, want) / F.size(cut)).otherwise(F.lit(0.0))
    return _bound(retrieved, relevant, body)


def mrr(retrieved: ColumnLike, relevant: ColumnLike) -> Column:
    def body(got: Column, want: Column) -> Column:
        flags = F.transform(got, lambda x: F.array_contains(want, x))
        first = F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0))
        return F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))
    return _bound(retrieved, relevant, body)
