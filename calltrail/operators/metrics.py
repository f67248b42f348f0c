"""Text and retrieval metrics over tables of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.base import once


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _counted(pairs: DataFrame, key, generated: str, expected: str, orders: Sequence[int] = (), lcs: bool = False) -> DataFrame:
    """keys and the counts of each pair: n_generated, n_expected, shared_<n>, lcs."""
    counts = X.pair_counts(orders, lcs)(X.normalize_text(generated), X.normalize_text(expected))
    return pairs.select(*_keys(key), counts.alias("_c")).select(*_keys(key), "_c.*")


G, E = "n_generated", "n_expected"


def token_f1(pairs: DataFrame, key, generated: str = "generated", expected: str = "expected") -> DataFrame:
    rows = _counted(pairs, key, generated, expected, [1])
    return rows.select(*_keys(key), X.f1_of("shared_1", G, E).alias("f1_score"))


def rouge_n(pairs: DataFrame, key, n: int, generated: str = "generated", expected: str = "expected") -> DataFrame:
    rows = _counted(pairs, key, generated, expected, [n])
    return rows.select(*_keys(key), X.rouge_of(f"shared_{n}", G, E, n).alias(f"rouge_{n}"))


def rouge_l(pairs: DataFrame, key, generated: str = "generated", expected: str = "expected") -> DataFrame:
    rows = _counted(pairs, key, generated, expected, lcs=True)
    return rows.select(*_keys(key), X.rouge_of("lcs", G, E, 1).alias("rouge_l"))


def bleu4(pairs: DataFrame, key, generated: str = "generated", expected: str = "expected") -> DataFrame:
    rows = _counted(pairs, key, generated, expected, [1, 2, 3, 4])
    return rows.select(*_keys(key), X.bleu_of([F.col(f"shared_{n}") for n in range(1, 5)], G, E).alias("bleu"))


def text_scores(pairs: DataFrame, keep: Sequence[str], generated: str = "generated", expected: str = "expected") -> DataFrame:
    """All text metrics in one pass over shared tokens, next to the columns ``keep``; NULL without expected text."""
    given = F.coalesce(F.col(expected), F.lit("")) != ""
    left, right = (F.when(given, X.normalize_text(c)) for c in (generated, expected))
    rows = once(pairs.select(*keep, generated, expected), _l=left, _r=right)
    rows = rows.select(*keep, (F.col("_l") == F.col("_r")).cast("int").alias("exact_match"), X.pair_counts([1, 2, 3, 4], lcs=True)("_l", "_r").alias("_c"))
    rows = rows.select(*keep, "exact_match", "_c.*")

    def score(value: Column, name: str) -> Column:
        return F.when(F.col("exact_match").isNotNull(), value).alias(name)

    return rows.select(
        *keep, "exact_match", score(X.f1_of("shared_1", G, E), "f1_score"),
        score(X.rouge_of("shared_1", G, E, 1), "rouge_1"), score(X.rouge_of("shared_2", G, E, 2), "rouge_2"),
        score(X.rouge_of("lcs", G, E, 1), "rouge_l"),
        score(X.bleu_of([F.col(f"shared_{n}") for n in range(1, 5)], G, E), "bleu"))


def text_metrics(pairs: DataFrame, key, generated: str = "generated", expected: str = "expected") -> DataFrame:
    """All text metrics per pair; pairs without expected text drop out."""
    usable = pairs.filter(F.coalesce(F.col(expected), F.lit("")) != "")
    return text_scores(usable, _keys(key), generated, expected)
