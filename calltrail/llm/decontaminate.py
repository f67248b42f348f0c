"""Benchmark decontamination: test items found in texts within an edit budget, by pieces and Myers' bit vectors.

An item of n words with an error budget of e words is split into e + 1 pieces; where it occurs with at most e edits, one
piece at least occurs unchanged (pigeonhole). Exact piece hits propose places, and Myers' bit-parallel algorithm (1999)
over the words decides them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import LOWER, find_words, inside_rows, mix, row_blocks, window_hashes, word_hashes

#: Share of an item's words that may be edited, and the least number of words an item must have to be looked for.
ERROR_RATE, MIN_WORDS = 0.2, 8
#: Item text that goes to every task at once; beyond it documents are screened once, and passes read what the screen left.
ITEM_BYTES = 8 << 20
#: Bits of the screen (a Bloom filter): 32 for each piece at least, within these powers of two (32 MB at most); probes of a hash.
SCREEN_BITS, PROBES = (15, 28), 8

Index = tuple[list[int], list[list[int]], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def budget(n_words: int, error_rate: float = ERROR_RATE) -> int:
    return int(n_words * error_rate)


def _hashed(texts: list[str]) -> list[np.ndarray]:
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    words = find_words(LOWER[np.concatenate(data)] if data else np.zeros(0, np.uint8), offsets)
    hashes = word_hashes(words)
    return [hashes[words.first[i]:words.first[i + 1]] for i in range(len(texts))]


def _cuts(n_words: int, error_rate: float) -> list[int]:
    """Bounds of an item's pieces, one more than may be edited."""
    e = budget(n_words, error_rate)
    return [n_words * k // (e + 1) for k in range(e + 2)]


def build_index(items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> Index:
    """Item ids, their words' hashes, and by piece length: sorted piece hashes with item and place."""
    ids, found, pieces = [], [], {}
    for (item, _), words in zip(items, _hashed([t or "" for _, t in items])):
        n = len(words)
        if n < min_words:
            continue
        cuts = _cuts(n, error_rate)
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(b - a, []).append((int(window_hashes(words[a:b], b - a)[0]), len(ids), a))
        ids.append(item)
        found.append([int(w) for w in words])
    table = {}
    for size, rows in pieces.items():
        rows.sort()
        table[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return ids, found, table


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any run of ``text`` and where that run ends (the first such end)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _search(index, error_rate: float):
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, pieces = index.value
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                words = find_words(LOWER[data], offsets)
                hashes = word_hashes(words)
                proposed: set[tuple[int, int, int]] = set()  # row, item, where the item would begin
                for size, (keys, item_of, place) in pieces.items():
                    windows = window_hashes(hashes, size)
                    if not len(windows):
                        continue
                    left = np.searchsorted(keys, windows, "left")
                    hit = np.flatnonzero((keys[np.minimum(left, len(keys) - 1)] == windows) & inside_rows(words.first, size))
                    right = np.searchsorted(keys, windows[hit], "right")
                    rows = np.searchsorted(words.first, hit, side="right") - 1
                    for at, row, lo, hi in zip(hit.tolist(), rows.tolist(), left[hit].tolist(), right.tolist()):
                        proposed.update((row, int(item_of[k]), at - int(place[k])) for k in range(lo, hi))
                best: dict[tuple[int, int], tuple[int, int]] = {}
                reached: dict[tuple[int, int], int] = {}
                for row, item, begin in sorted(proposed):
                    first, last = int(words.first[row]), int(words.first[row + 1])
                    m = len(items[item])
                    e = budget(m, error_rate)
                    # Places close together are covered by one search.
                    if begin <= reached.get((row, item), -1 - e):
                        continue
                    reached[(row, item)] = begin + e
                    a, b = max(first, begin - e), min(last, begin + m + 2 * e)
                    distance, end = best_match(items[item], hashes[a:b].tolist())
                    if distance <= e and (distance, a + end - first) < best.get((row, item), (e + 1, 0)):
                        best[(row, item)] = (distance, a + end - first)
                if best:
                    docs = part.column(0).to_pylist()
                    rows = [(docs[row], ids[item], d, end) for (row, item), (d, end) in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
    return run


def _pieces(error_rate: float, min_words: int):
    """(size, hash) of each piece of the items in a column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *_ in row_blocks(batch, "text"):
                sizes, hashes = [], []
                for words in _hashed(part.column("text").to_pylist()):
                    cuts = _cuts(len(words), error_rate) if len(words) >= min_words else []
                    for a, b in zip(cuts, cuts[1:]):
                        sizes.append(b - a)
                        hashes.append(window_hashes(words[a:b], b - a)[0])
                yield pa.record_batch({"size": pa.array(sizes, pa.int32()), "hash": pa.array(np.array(hashes, np.uint64).view(np.int64))})
    return run


def _probe(hashes: np.ndarray, k: int, power: int) -> np.ndarray:
    return mix(hashes + np.uint64(k)) >> np.uint64(64 - power)


def _places(power: int):
    """Places of the screen that the pieces set, counted from one as Spark's bitmap functions do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(PROBES):
                yield pa.record_batch({"place": pa.array(_probe(hashes, k, power).view(np.int64) + 1)})
    return run


def _screened(screen):
    """Rows of (doc_id, text) in which a window of words may be a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, power, bits = screen.value
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                words = find_words(LOWER[data], offsets)
                hashes = word_hashes(words)
                likely = np.zeros(part.num_rows, bool)
                for size in sizes:
                    windows = window_hashes(hashes, size)
                    hit = np.flatnonzero(inside_rows(words.first, size))
                    for k in range(PROBES):
                        place = _probe(windows[hit], k, power)
                        hit = hit[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    likely[np.searchsorted(words.first, hit, side="right") - 1] = True
                if likely.any():
                    yield part.filter(pa.array(likely))
    return run


def suspects(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) that may hold a piece of an item, written: all that can hold an item, and few more.

    Spark makes the bits of all pieces; at most 32 MB of them go through the driver to every task, whatever the number of items.
    """
    spark = docs.sparkSession
    pieces = written(items.select("text").mapInArrow(_pieces(error_rate, min_words), "size int, hash long"), "pieces")
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())
    power = min(max((32 * pieces.count()).bit_length(), SCREEN_BITS[0]), SCREEN_BITS[1])
    maps = (pieces.select("hash").mapInArrow(_places(power), "place long").groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    bits = np.zeros(1 << (power - 3), np.uint8)
    for r in maps.collect():
        begin = (r["bucket"] - 1) * 4096
        bits[begin:begin + 4096] = np.frombuffer(r["bits"], np.uint8)
    return written(docs.select("doc_id", "text").mapInArrow(_screened(spark.sparkContext.broadcast((sizes, power, bits))), docs.select("doc_id", "text").schema), "suspects")


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, end_word) for every document and item that occurs in it within its error budget.

    Words are parted by white space and lower-cased in A-Z; an edit inserts, deletes or changes a word; an item of n words
    may have ``floor(error_rate * n)`` of them. The best place is given: least distance, then the earliest end (words
    counted in the document, exclusive).

    Cases: NULL and empty texts contain nothing; items with fewer than ``min_words`` words or without text are not looked
    for; items of equal text are all reported; a repeated document is reported for each row; NULL ids are reported as
    such. Items are read in blocks of ``item_bytes`` of text. With one block there is one pass over the documents; with more
    the documents are screened in one pass (``suspects``), and each block's pass reads only what may hold a piece.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    schema = "doc_id long, item_id long, distance long, end_word long"
    result, block, size = None, [], 0
    if (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) > item_bytes:
        narrow = suspects(narrow, wanted, error_rate, min_words)

    def searched(now: list[tuple[int, str]], before: DataFrame | None) -> DataFrame:
        index = spark.sparkContext.broadcast(build_index(now, error_rate, min_words))
        found = narrow.mapInArrow(_search(index, error_rate), schema)
        return found if before is None else before.unionAll(found)

    for row in wanted.orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= item_bytes:
            result, block, size = searched(block, result), [], 0
    return searched(block, result) if block or result is None else result
