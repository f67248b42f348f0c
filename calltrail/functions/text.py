"""Text-similarity metrics (H1 to H6).

Texts are normalised by built-in expressions. Counting shared n-grams and common
subsequences is per-row work on two token lists: one Arrow function returns
all counts of a pair at once (about ten times faster than the same counting
with array lambdas, which Spark interprets), and the scores are built-in
arithmetic on the counts again. Nothing is exploded or shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE_CHARS, WORD, ColumnLike, as_col

# Punctuation and articles removed before comparing.
PUNCTUATION = """.,/#!$%^&*;:{}=-_`~()?\""""
ARTICLES = f"(?=[at])(?<!{WORD})(?:an?|the)(?!{WORD})"


def normalize_text(text: ColumnLike) -> Column:
    """Lower case without punctuation and articles, single spaces.

    One ``translate`` turns every kind of white space into a blank and deletes
    the punctuation, so the patterns left to match are short.
    """
    c = F.lower(F.coalesce(as_col(text), F.lit("")))
    c = F.translate(c, SPACE_CHARS + PUNCTUATION, " " * len(SPACE_CHARS))
    c = F.regexp_replace(c, ARTICLES, "")
    return F.trim(F.regexp_replace(c, "  +", " "))


def exact_match(generated: ColumnLike, expected: ColumnLike) -> Column:
    return (normalize_text(generated) == normalize_text(expected)).cast("int")


def f1_of(overlap: ColumnLike, n_generated: ColumnLike, n_expected: ColumnLike) -> Column:
    o, g, e = as_col(overlap).cast("double"), as_col(n_generated), as_col(n_expected)
    precision, recall = o / g, o / e
    return F.when((g == 0) | (e == 0) | (o == 0), F.lit(0.0)).otherwise(
        (F.lit(2.0) * precision * recall) / (precision + recall))


def rouge_of(overlap: ColumnLike, n_generated: ColumnLike, n_expected: ColumnLike, n: int) -> Column:
    """Recall of n-grams; counts are token counts."""
    o, g, e = as_col(overlap).cast("double"), as_col(n_generated), as_col(n_expected)
    return F.when((g < n) | (e < n), F.lit(0.0)).otherwise(o / (e - (n - 1)))


def bleu_of(overlaps: list[Column], n_generated: ColumnLike, n_expected: ColumnLike) -> Column:
    """Four clipped precisions of weight 1/4; zero precisions are left out of the mean."""
    g, e = as_col(n_generated), as_col(n_expected)
    logs, hits = F.lit(0.0), F.lit(0)
    for n, o in enumerate(overlaps, start=1):
        used = (g >= n) & (e >= n) & (o > 0)
        logs = logs + F.when(used, F.lit(0.25) * F.log(o.cast("double") / (g - (n - 1)))).otherwise(F.lit(0.0))
        hits = hits + F.when(used, F.lit(1)).otherwise(F.lit(0))
    brevity = F.when(g > e, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - e / g))
    return F.when((g == 0) | (e == 0) | (hits == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs))


class LcsRows:
    """Rows of the LCS table of ``a`` against ``b`` as bit sets: bit j clear means that the
    table grows between columns j and j+1 (bit-parallel recurrence of Hyyrö).

    Only every ``step``-th row is kept, and one block of rows in between, so memory grows with
    the root of the number of rows; walking backwards makes each block once more. Of the places of
    an item in ``b`` only a list is kept; those that stand at more places than the root of its
    length, of which there are no more than that root, also keep theirs as a bit set.
    """

    def __init__(self, a: list, b: list):
        self.a, self.full = a, (1 << len(b)) - 1
        used = set(a)
        places: dict = {}
        for j, item in enumerate(b):
            if item in used:
                places.setdefault(item, []).append(j)
        often = math.isqrt(len(b))
        self.places = places
        self.masks = {item: self._mask(at) for item, at in places.items() if len(at) > often}
        self.step = max(1, math.isqrt(len(a)))
        self.starts, self.block, self.at = [], [], -1
        self.last = self.full
        for i, item in enumerate(a):
            if i % self.step == 0:
                self.starts.append(self.last)
            self.last = self._next(self.last, item)

    def _mask(self, at: list[int]) -> int:
        if len(at) < 4:
            return sum(1 << j for j in at)
        bits = bytearray(at[-1] // 8 + 1)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def _next(self, v: int, item) -> int:
        at = self.places.get(item)
        if at is None:
            return v
        u = v & (self.masks.get(item) or self._mask(at))
        return ((v + u) | (v - u)) & self.full

    def __getitem__(self, i: int) -> int:
        k = i // self.step
        if k != self.at:
            v, self.block, self.at = self.starts[k], [], k
            for item in self.a[k * self.step:(k + 1) * self.step]:
                v = self._next(v, item)
                self.block.append(v)
        return self.block[i - k * self.step]


def lcs_length(a: list, b: list) -> int:
    if not a or not b:
        return 0
    return len(b) - LcsRows(a, b).last.bit_count()


def shared_ngrams(a: list, b: list, n: int) -> int:
    """Size of the bag intersection of the n-grams of two token lists."""
    if len(a) < n or len(b) < n:
        return 0
    left = Counter(zip(*[a[i:] for i in range(n)]))
    right = Counter(zip(*[b[i:] for i in range(n)]))
    return (left & right).total()


def pair_counts(orders: Sequence[int] = (), lcs: bool = False):
    """Arrow function over two normalised texts: token counts, shared n-grams per order, LCS length."""
    names = ["n_generated", "n_expected", *[f"shared_{n}" for n in orders], *(["lcs"] if lcs else [])]
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in names])

    @F.pandas_udf(kind)
    def counts(generated: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(generated, expected):
            a, b = (x.split(" ") if x else []), (y.split(" ") if y else [])
            rows.append([len(a), len(b), *[shared_ngrams(a, b, n) for n in orders], *([lcs_length(a, b)] if lcs else [])])
        return pd.DataFrame(rows, columns=names, dtype="int32")
    return counts


def diff_lines(old: str, new: str) -> list[dict]:
    """Line edits from ``old`` to ``new``; on equal choices the later edit is an addition."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    out = []
    while a and b and a[-1] == b[-1]:  # the walk from the end takes equal lines first, so they need no table
        out.append({"type": "unchanged", "text": a.pop()})
        b.pop()
    rows = LcsRows(a, b)
    i, j = len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.append({"type": "unchanged", "text": a[i - 1]})
            i, j = i - 1, j - 1
        elif j and (i == 0 or (rows[i - 1] >> (j - 1)) & 1):
            out.append({"type": "added", "text": b[j - 1]})
            j -= 1
        else:
            out.append({"type": "removed", "text": a[i - 1]})
            i -= 1
    out.reverse()
    return out


EDITS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
_EDITS = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))


# Edits made at once: about so many characters of both texts, or one pair.
DIFF_CHARS = 1 << 20


def diff_blocks(pairs: Iterable[tuple[str, str]], limit: int = DIFF_CHARS) -> Iterator[list[list[dict]]]:
    """Edits of pairs of texts in lists that come from about ``limit`` characters; an edit takes many times the memory of its line."""
    block, size = [], 0
    for old, new in pairs:
        block.append(diff_lines(old, new))
        size += len(old or "") + len(new or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


@F.arrow_udf(EDITS)
def line_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edits leave in smaller batches than the texts come in, so a worker holds those of few texts."""
    for old, new in batches:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(old, new))
        for block in diff_blocks(pairs):
            yield pa.array(block, _EDITS)
