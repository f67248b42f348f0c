"""Removal of long repeated passages by compacting repeated paths of a de Bruijn graph of words.

The edges of the graph are the windows of ``WINDOW`` consecutive words. A window is represented by its minimizer, the
``SEED`` words with the smallest hash in it; consecutive windows of a text with one minimizer form a path. Where all
occurrences of a minimizer lie on equal paths, the path has no branch and one row stands for all its windows; only at
branching minimizers the windows are compared one by one. Each step is a Spark aggregation or join on hashes of words;
the smallest (document, place) of a path or window is its source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import likely_in, split_likely, without, written
from .words import Words, find_words, inside_rows, mix, row_blocks, window_hashes, word_hashes

WINDOW, SEED = 13, 5
#: Bits of the map of minimizers that are in two documents or more: 32 MB at most in every task, whatever the input. A
#: fuller map lets more rows through to the exact steps and changes no result.
MAP_BITS = 28
#: Ranges of minimizers: more ranges make smaller tasks.
RANGES = 256
_PLACE = 40  # bits of a place below the tag


def _minimizers(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window over all words: hash of its minimizer and where that begins (the leftmost of equal ones)."""
    seeds = window_hashes(hashes, seed)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = seeds[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - seed + 1):
        now = seeds[j:j + n]
        less = now < best
        best[less] = now[less]
        at[less] = j
    return best, np.arange(n) + at


def _paths(words: Words, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the rows: minimizer, first window and number of windows of each."""
    best, at = _minimizers(hashes, words.first, window, seed)
    keep = inside_rows(words.first, window)
    if not keep.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = keep.copy()
    start[1:] &= ~keep[:-1] | (at[1:] != at[:-1])
    # The first window of a row begins a path even if the last one of the row before is right in front of it.
    lead = words.first[:-1][np.diff(words.first) >= window]
    start[lead] = True
    begins = np.flatnonzero(start)
    total = np.concatenate([[0], np.cumsum(keep)])
    nexts = np.append(begins[1:], len(keep))
    return best[begins], begins, total[nexts] - total[begins]


def _row_of(words: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, places, side="right") - 1


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in row_blocks(batch, "text"):
            words = find_words(data, offsets)
            hashes = word_hashes(words)
            keys = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "row_key": part.column("row_key"), "n_words": pa.array(np.diff(words.first).astype(np.int64)), "words_key": pa.array(keys, pa.binary())})


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of seven bits a byte."""
    steps = np.diff(values, prepend=np.uint64(0))
    sizes = np.ones(len(steps), np.int64)
    for k in range(1, 10):
        sizes += steps >= np.uint64(1 << (7 * k)) if 7 * k < 64 else 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[ends[some] - sizes[some] + k] = ((steps[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    parts = (data & np.uint8(127)).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.cumsum(np.add.reduceat(parts, begin)) if len(last) else np.zeros(0, np.uint64)


def _seen(ranges: int):
    """For each range of minimizers, packed: those of a task's rows, and those among them in two documents or more."""
    def emit(values: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        m, d = np.concatenate(values), np.concatenate(docs)
        order = np.lexsort((d, m))
        m, d = m[order], d[order]
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        group = np.cumsum(new) - 1
        single = m[new]
        twice = np.zeros(len(single), bool)
        twice[group[1:][~new[1:] & (d[1:] != d[:-1])]] = True
        owner = (single >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(ranges + 1))
        cut = np.uint64(24)  # 40 bits are enough to tell them apart here; equal ones are only looked at again
        yield pa.record_batch({
            "part": pa.array(np.arange(ranges), pa.int32()),
            "single": pa.array([_pack_sorted(single[a:b] >> cut) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            "twice": pa.array([_pack_sorted(single[a:b][twice[a:b]] >> cut) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs, size = [], [], 0
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                words = find_words(data, offsets)
                m, begins, _ = _paths(words, word_hashes(words), WINDOW, SEED)
                values.append(m)
                docs.append(part.column("doc_id").to_numpy()[_row_of(words, begins)])
                size += len(m)
                if size > 2_000_000:
                    yield from emit(values, docs)
                    values, docs, size = [], [], 0
        if size:
            yield from emit(values, docs)
    return run


def _shared_map(ranges: int, bits: int):
    """The part of the bit map that belongs to a range."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, found = [], []
        for batch in batches:
            for s, t in zip(batch.column("single").to_pylist(), batch.column("twice").to_pylist()):
                singles.append(_unpack_sorted(s))
                found.append(_unpack_sorted(t))
        every = np.sort(np.concatenate(singles))
        shared = np.concatenate([every[1:][every[1:] == every[:-1]], *found])
        spots = (shared >> np.uint64(40 - bits)) & np.uint64((1 << bits) // ranges - 1)
        flags = np.zeros((1 << bits) // ranges, np.uint8)
        flags[spots.astype(np.int64)] = 1
        yield pa.record_batch({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})
    return run


def _shared_paths(shared, bits: int):
    """One row for each path whose minimizer may be in several documents, with the hashes of its windows."""
    out = pa.schema([("m", pa.int64()), ("path", pa.int64()), ("doc_id", pa.int64()), ("spot", pa.int64()), ("windows", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                words = find_words(data, offsets)
                hashes = word_hashes(words)
                m, begins, lengths = _paths(words, hashes, WINDOW, SEED)
                spot = (m >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero(flags[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1) if len(m) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                m, begins, lengths = m[hit], begins[hit], lengths[hit]
                rows = _row_of(words, begins)
                ends = np.cumsum(lengths)
                inner = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
                windows = window_hashes(hashes, WINDOW)[np.repeat(begins, lengths) + inner]
                whole = np.add.reduceat(mix(windows + inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ends - lengths)
                place = (begins - words.first[rows]) | (part.column("tag").to_numpy()[rows].astype(np.int64) << _PLACE)
                yield pa.RecordBatch.from_arrays([
                    pa.array(m.view(np.int64)), pa.array(mix(whole + lengths.astype(np.uint64)).view(np.int64)), pa.array(part.column("doc_id").to_numpy()[rows]), pa.array(place),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(windows.view(np.int64)))], schema=out)
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in row_blocks(batch, "text"):
            words = find_words(data, offsets)
            removed, digests, texts = [], [], []
            spots = part.column("spots").to_pylist()
            copies = part.column("copied").to_pylist()
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                gone = np.zeros(b - a + 1, np.int64)
                if copies[i]:
                    gone[0] = b - a >= WINDOW
                for s in spots[i] or ():
                    at = s["spot"] & ((1 << _PLACE) - 1)
                    gone[at] += 1
                    gone[at + s["n"] + WINDOW - 1] -= 1
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                text = b" ".join(data[p:q].tobytes() for p, q in zip(words.starts[left], words.ends[left]))
                removed.append(b - a - len(left))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8", "replace"))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(words.first).astype(np.int64)), "n_removed": pa.array(np.array(removed, np.int64)), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string())})


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated paths of ``docs`` (doc_id, text, row_key, tag; equal texts once): doc_id, spot, n windows, source_doc, source_spot.

    A spot is the place of the first window, in words, below the row's tag.
    """
    spark = docs.sparkSession
    seen = docs.select("doc_id", "text").mapInArrow(_seen(RANGES), "part int, single binary, twice binary")
    parts = seen.groupBy("part").applyInArrow(_shared_map(RANGES, MAP_BITS), "part int, bits binary")
    bits = bytearray((1 << MAP_BITS) // 8)
    width = len(bits) // RANGES
    for row in parts.toLocalIterator():
        bits[row["part"] * width:(row["part"] + 1) * width] = row["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    paths = written(docs.select("doc_id", "text", "tag").mapInArrow(_shared_paths(shared, MAP_BITS), "m long, path long, doc_id long, spot long, windows array<long>"), "paths")
    sources = paths.groupBy("m", "path").agg(F.min(F.struct("doc_id", "spot")).alias("source"))
    sources = written(sources, "sources")
    branching = written(sources.groupBy("m").agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").select("m"), "branching")
    whole = (paths.select("m", "path", "doc_id", "spot", F.size("windows").cast("long").alias("n")).join(sources, ["m", "path"])
             .filter("doc_id > source.doc_id").select("doc_id", "spot", "n", F.col("source.doc_id").alias("source_doc"), F.col("source.spot").alias("source_spot")))
    # At branches a window may also be in a smaller document on another path.
    windows = likely_in(paths, branching, "m").select("m", "doc_id", "spot", F.posexplode("windows").alias("i", "w")).select("m", "w", "doc_id", (F.col("spot") + F.col("i")).alias("spot"))
    least = windows.groupBy("m", "w").agg(F.min(F.struct("doc_id", "spot")).alias("source"), F.max("doc_id").alias("most")).filter("most > source.doc_id").drop("most")
    single = (windows.join(least, ["m", "w"]).filter("doc_id > source.doc_id")
              .select("doc_id", "spot", F.lit(1).cast("long").alias("n"), F.col("source.doc_id").alias("source_doc"), F.col("source.spot").alias("source_spot")))
    return whole.unionAll(single)


def repeated_spans(found: DataFrame) -> DataFrame:
    """Longest spans: paths and windows of a document that follow each other in the same source are one span.

    doc_id, from_word, n_words, source_doc, source_from. A span is verified by its source's places: each of its paths lies at
    the same distance from the place that it repeats.
    """
    low = F.lit((1 << _PLACE) - 1)
    placed = found.select("doc_id", F.shiftright("spot", _PLACE).alias("tag"), F.col("spot").bitwiseAND(low).alias("at"), "n", "source_doc", F.col("source_spot").bitwiseAND(low).alias("source_at"))
    lane = Window.partitionBy("doc_id", "tag", "source_doc", F.col("at") - F.col("source_at")).orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(lane.rowsBetween(Window.unboundedPreceding, -1))
    opened = placed.withColumn("open", (F.coalesce(reach, F.lit(-1)) < F.col("at")).cast("int")).withColumn("shift", F.col("at") - F.col("source_at"))
    island = opened.withColumn("island", F.sum("open").over(Window.partitionBy("doc_id", "tag", "source_doc", "shift").orderBy("at", "n")))
    return island.groupBy("doc_id", "tag", "source_doc", "shift", "island").agg(
        F.min("at").alias("from_word"), (F.max(F.col("at") + F.col("n")) - F.min("at") + WINDOW - 1).alias("n_words"), F.min("source_at").alias("source_from")).select(
        "doc_id", "from_word", "n_words", "source_doc", "source_from")


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with keys, the row keys of texts that a smaller document has word for word, rows that stand for their text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = narrow.withColumns({"row_key": F.xxhash64("doc_id", "text"), "tag": F.pmod(F.xxhash64("text"), F.lit(65536)).cast("int")})
    described = written(narrow.select("doc_id", "text", "row_key").mapInArrow(_describe, "doc_id long, row_key long, n_words long, words_key binary"), "described")
    whole = described.filter("doc_id IS NOT NULL").filter(F.col("n_words") >= WINDOW)
    least = whole.groupBy("words_key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("words_key", "least")
    copies = written(whole.join(least, "words_key").filter("doc_id > least").select("row_key").distinct(), "copies")
    return narrow, copies, without(narrow.filter("doc_id IS NOT NULL"), copies, "row_key")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text for each row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space. A word goes if a window of ``WINDOW`` words that covers it also starts, word
    for word, in a document with a smaller doc_id; windows are those of the input. Kept words are joined by one space.

    Cases: NULL, empty and short texts lose nothing (NULL counts as empty); a text that a smaller document equals word
    for word loses all words; repeats inside one document and rows that share a doc_id do not remove each other; a NULL
    id is never a source and loses nothing; an empty table gives no rows. Other columns are not looked at.
    """
    narrow, copies, firsts = _prepared(docs)
    found = repeats(firsts)
    spots = written(found.groupBy("doc_id", F.shiftright("spot", _PLACE).cast("int").alias("tag")).agg(F.collect_list(F.struct("spot", "n")).alias("spots")), "spots")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    none = F.lit(None).cast("array<struct<spot: bigint, n: bigint>>").alias("spots")
    copied = likely_in(narrow, copies, "row_key").join(copies, "row_key", "left_semi")
    marked = spots.select("doc_id").distinct()
    likely, rest = split_likely(firsts, marked, "doc_id")
    likely = likely.join(spots, ["doc_id", "tag"], "left").select("doc_id", "text", "spots", F.lit(False).alias("copied"))
    rest = rest.select("doc_id", "text", none, F.lit(False).alias("copied"))
    nameless = narrow.filter("doc_id IS NULL").select("doc_id", "text", none, F.lit(False).alias("copied"))
    rows = likely.unionAll(rest).unionAll(nameless).unionAll(copied.select("doc_id", "text", none, F.lit(True).alias("copied")))
    return rows.mapInArrow(_remove, schema)

