"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on full shingle sets.

Signatures follow C-MinHash (Li & Li, 2022): one permutation, sigma, breaks up the structure of the input; a second
one, pi, shifted circularly by k, gives coordinate k: min over the set of pi((sigma(v) + k * step) mod 2^32). Both are
bijections of the 32-bit universe, so two permutations stand for all coordinates (step is odd: distinct shifts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, likely_in, written
from .words import LOWER, find_words, inside_rows, mix, row_blocks, window_hashes, word_hashes

SHINGLE = 5
BANDS, BAND_ROWS = 20, 4
#: Percent of the union that the intersection must reach.
PERCENT = 85
#: Share of coordinates that must agree before sets are compared. At a similarity of 0.85 fewer agree with probability
#: 1e-8; a pair of that similarity misses all bands with probability 4e-7, a closer one with less.
LEAST_AGREEING = 0.6
#: The same for a similarity of 0.8 or more, where no other one is asked for. Such a pair misses all bands with
#: probability 5e-8, and fewer of its coordinates agree with 1e-14.
NEAR = {"percent": 80, "bands": 32, "band_rows": 4, "least_agreeing": 0.5}
#: Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BLOCK_ROWS = 256
_STEP = np.uint32(0x9E3779B1)


def _pi(x: np.ndarray) -> np.ndarray:
    """The permutation pi of 32-bit numbers (the finalizer of MurmurHash3); changes ``x``."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows x size, cut to 16 bits) of the sets ``values[bounds[i]:bounds[i + 1]]``, none of them empty."""
    out = np.empty((len(bounds) - 1, size), np.uint16)
    shifted = (mix(values ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)  # sigma
    work = np.empty_like(shifted)
    for k in range(size):
        np.copyto(work, shifted)
        out[:, k] = np.minimum.reduceat(_pi(work), bounds[:-1]) & np.uint32(0xFFFF)
        shifted += _STEP
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, the rows' bounds in them, and their numbers of words. A shorter row is one shingle."""
    words = find_words(LOWER[data], offsets)
    hashes = word_hashes(words)
    counts = np.diff(words.first)
    rows = np.repeat(np.arange(len(counts)), counts)
    keep = inside_rows(words.first, size)
    shingles, owner = window_hashes(hashes, size)[keep], rows[:len(keep)][keep]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        alone = [window_hashes(hashes[words.first[i]:words.first[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i]) for i in short]
        shingles, owner = np.concatenate([shingles, np.array(alone, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(counts) + 1)), counts.astype(np.int64)


_SKETCH = "doc_id long, n_words long, n_shingles long, set_key binary, signature binary, carried "


def _sketch(bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                values, bounds, n_words = shingle_sets(data, offsets)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                keys: list[bytes | None] = [None] * len(sizes)
                marks: list[bytes | None] = [None] * len(sizes)
                if len(full):
                    made = signatures(values, np.append(bounds[full], bounds[-1]), bands * band_rows)
                    for i, row in zip(full, made):
                        keys[i] = hashlib.blake2b(values[bounds[i]:bounds[i + 1]].tobytes(), digest_size=16).digest()
                        marks[i] = row.tobytes()
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(n_words), "n_shingles": pa.array(sizes), "set_key": pa.array(keys, pa.binary()),
                                       "signature": pa.array(marks, pa.binary()), "carried": part.column("carried")})
    return run


def _sets_for_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place a document is compared at, with its shingle set."""
    out = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc_id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for part, data, offsets in row_blocks(batch, "text"):
            values, bounds, _ = shingle_sets(data, offsets)
            rows = []
            for i, (doc, targets) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("targets").to_pylist())):
                mine = values[bounds[i]:bounds[i + 1]].tobytes()
                rows += [(t["band"], t["bucket"], t["lo"], t["hi"], doc, mine) for t in targets]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)


_PLACED = ("band", "bucket", "lo", "hi")
# Pairs whose signatures are compared at once.
_PAIRS = 1 << 16


def _pairs(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are compared at one place: within its block, or across its two blocks."""
    if lo == hi:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _comparable(bands: int, band_rows: int, least: int, percent: int):
    """Rows, which come sorted by place, that have a partner worth comparing there; a pair counts in its first common band only.

    A place has at most two blocks of rows, so the rows held back for the next batch are few.
    """
    def worth(marks: np.ndarray, sizes: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
        i, j = i[near], j[near]
        equal = marks[i] == marks[j]
        close = equal.sum(1) >= least
        whole = equal[close].reshape(-1, bands, band_rows).all(2)
        first = whole.argmax(1) == band[i[close]]
        return np.concatenate([i[close][first], j[close][first]])

    def rows_of(batch: pa.Table, starts: np.ndarray) -> pa.Table:
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        sizes, band, block, lo, hi = (batch.column(c).to_numpy() for c in ("n_shingles", "band", "block", "lo", "hi"))
        wanted = np.zeros(batch.num_rows, bool)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0
        for k, start in enumerate(starts[:-1]):
            i, j = _pairs(block[start:starts[k + 1]], lo[start], hi[start])
            left.append(i + start)
            right.append(j + start)
            held += len(i)
            if held >= _PAIRS or k == len(starts) - 2:
                a, b = np.concatenate(left), np.concatenate(right)
                for at in range(0, len(a), _PAIRS):
                    wanted[worth(marks, sizes, band, a[at:at + _PAIRS], b[at:at + _PAIRS])] = True
                left, right, held = [], [], 0
        return batch.select([*_PLACED, "doc_id"]).filter(pa.array(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            places = [now.column(c).to_numpy() for c in _PLACED]
            new = np.logical_or.reduce([x[1:] != x[:-1] for x in places])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            rest = now.slice(int(starts[-1]))
            if len(starts) > 1:
                yield from rows_of(now.slice(0, int(starts[-1])), starts).to_batches()
        if rest is not None:
            yield from rows_of(rest, np.array([0, rest.num_rows])).to_batches()
    return run


def _linked(percent: int):
    """Links of a block pair as a spanning forest: (a, b), at most one fewer than rows."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        order = np.argsort(size, kind="stable")
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        # Occurrences of each shingle that is in two sets at least, by shingle, as a sparse table.
        owner = np.repeat(np.arange(len(sets)), size)
        values = np.concatenate(sets)
        at = np.argsort(values, kind="stable")
        _, where, counts = np.unique(values[at], return_index=True, return_counts=True)
        code = np.full(len(values), -1)
        code[at] = np.repeat(np.where(counts > 1, np.arange(len(where)), -1), counts)
        begin = np.concatenate([[0], np.cumsum(size)])
        owner_sorted = owner[at]
        pairs: list[tuple[int, int]] = []
        for i in order:
            mine = code[begin[i]:begin[i + 1]]
            mine = mine[mine >= 0]
            if not len(mine):
                continue
            reach = np.repeat(where[mine] - np.concatenate([[0], np.cumsum(counts[mine])[:-1]]), counts[mine]) + np.arange(counts[mine].sum())
            common = np.bincount(owner_sorted[reach], minlength=len(sets))
            union = size + size[i] - common
            for j in np.flatnonzero((100 * common >= percent * union) & (np.arange(len(sets)) != i)):
                a, b = find(int(i)), find(int(j))
                if a != b:
                    root[a] = b
                    pairs.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS,
                    percent: int = PERCENT, block_rows: int = BLOCK_ROWS, least_agreeing: float = LEAST_AGREEING, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; with ``carry`` also n_words and those columns of ``docs`` as the struct carried.

    Words are lower-cased in A-Z and parted by ASCII white space; shingles have five words, a shorter text is one shingle.
    Documents are linked when 100 * |intersection| >= percent * |union| of their full shingle sets; component_id is the
    smallest doc_id reachable, kept is doc_id = component_id.

    Cases: NULL, empty or blank texts have no shingles and are linked with nothing. Equal sets (copies, repeated rows)
    are one node, so a group of copies of any size costs one comparison. A NULL id is linked with nothing: its
    component_id is NULL and it is kept. Rows that share an id share its component. Other columns are not looked at.

    Plan: sketches are written once; equal sets meet by a 128-bit key; band buckets of two or more distinct sets are dealt
    out in blocks of ``block_rows``, so a bucket of any size spreads over tasks; full sets are made again only for
    documents with a plausible partner and sent to where they are compared; tasks return spanning forests, not all pairs.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(True)
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    sketched = written(wide.mapInArrow(_sketch(bands, band_rows), _SKETCH + wide.schema["carried"].dataType.simpleString()), "sketches")
    narrow = wide.select("doc_id", "text")
    known = sketched.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    nodes = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    width = 2 * band_rows
    band_key: Column = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)).alias("bucket")) for b in range(bands)])
    keyed = nodes.select("doc_id", F.inline(band_key))
    sizes = keyed.groupBy("band", "bucket").agg(F.count("*").alias("members")).filter("members > 1")
    member = keyed.join(sizes, ["band", "bucket"]).join(nodes.select("doc_id", "n_shingles", "signature"), "doc_id")
    # Blocks depend on values: in a bucket of many rows they are numbered by a hash of the id.
    blocks = F.ceil(F.col("members") / F.lit(block_rows)).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "n_shingles", "signature")
    wanted = placed.repartition(*_PLACED).sortWithinPartitions(*_PLACED).mapInArrow(
        _comparable(bands, band_rows, int(least_agreeing * bands * band_rows), percent), "band int, bucket long, lo int, hi int, doc_id long")
    targets = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("band", "bucket", "lo", "hi")).alias("targets"))
    targets = written(targets, "targets")
    texts = likely_in(narrow, targets, "doc_id").join(targets, "doc_id").select("doc_id", "text", "targets")
    links = (texts.mapInArrow(_sets_for_targets, "band int, bucket long, lo int, hi int, doc_id long, shingles binary")
             .groupBy("band", "bucket", "lo", "hi").applyInArrow(_linked(percent), "a long, b long"))
    groups = components(links)
    named = nodes.select("set_key", F.col("doc_id").alias("node")).join(groups, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("found"))
    # A hot set key (a third of all rows may be one text) is split by adaptive execution: one side of this join is unique.
    joined = sketched.join(named, "set_key", "left")
    component = F.coalesce("found", "doc_id")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), *(["n_words", "carried"] if carry else [])).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
