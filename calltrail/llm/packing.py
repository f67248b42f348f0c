"""Best-fit packing of documents into training sequences, with conflicts between documents of one source or one cluster."""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a bin, and the number of pieces that one task packs on average.
CAPACITY, SHARD_ROWS = 2048, 4096
# Successors of a residual that are looked at in one step.
_STEP = 64


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; NULL has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")), F.lit(0)).cast("long")


class _Bins:
    """Open bins in order of residual, each with bitmaps of the sources and clusters it holds."""

    def __init__(self, sources: int, clusters: int, most: int):
        self.residual = np.zeros(most, np.int64)  # of bins in order
        self.bin = np.zeros(most, np.int64)
        self.count = self.made = 0
        self.sources = np.zeros((most, sources // 64 + 1), np.uint64)  # of bins by number
        self.clusters = np.zeros((most, clusters // 64 + 1), np.uint64)

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        """Put a piece into the tightest bin that has room and no conflict, or a new one; codes below 0 conflict with nothing."""
        at = int(np.searchsorted(self.residual[:self.count], size))
        s_word, s_bit = source >> 6, np.uint64(1 << (source & 63)) if source >= 0 else np.uint64(0)
        c_word, c_bit = cluster >> 6, np.uint64(1 << (cluster & 63)) if cluster >= 0 else np.uint64(0)
        found = -1
        while at < self.count and found < 0:
            some = self.bin[at:min(at + _STEP, self.count)]
            clash = (self.sources[some, s_word] & s_bit) | (self.clusters[some, c_word] & c_bit)
            free = np.flatnonzero(clash == 0)
            if len(free):
                found = at + int(free[0])
            else:
                at += len(some)
        if found >= 0:
            number, left = int(self.bin[found]), int(self.residual[found]) - size
        else:
            number, left, found = self.made, capacity - size, self.count
            self.made += 1
            self.count += 1
        to = int(np.searchsorted(self.residual[:found], left))
        self.residual[to + 1:found + 1] = self.residual[to:found].copy()
        self.bin[to + 1:found + 1] = self.bin[to:found].copy()
        self.residual[to], self.bin[to] = left, number
        self.sources[number, s_word] |= s_bit
        self.clusters[number, c_word] |= c_bit
        return number


def pack_pieces(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, pieces taken in the given order; equal codes of at least 0 must not share a bin."""
    bins = _Bins(int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1, len(sizes))
    return np.array([bins.place(int(n), int(s), int(c), capacity) for n, s, c in zip(sizes, sources, clusters)], np.int64)


def _codes(column: pa.ChunkedArray, only_repeated: bool = False) -> np.ndarray:
    encoded = column.combine_chunks().dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if only_repeated and len(codes):
        counts = np.bincount(codes[codes >= 0], minlength=1)
        again = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
        codes = np.where(codes >= 0, again[codes], -1)
    return codes


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        number = pack_pieces(table.column("n_tokens").to_numpy(), _codes(table.column("source")), _codes(table.column("cluster"), True), capacity)
        return table.append_column("bin", pa.array(number, pa.int64()))
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of documents packed into bins: shard, bin, doc_id, piece, n_tokens, source, cluster.

    ``items`` has doc_id, n_tokens, source and cluster. A document longer than ``capacity`` is cut into pieces, full ones
    first; no two pieces of one source or of one cluster share a bin, so a long document's pieces do not either. Pieces
    go, largest first, into the bin with the smallest residual that has room and no conflict.

    Cases: no tokens (NULL, zero or negative) means no piece; a NULL source or cluster conflicts with nothing; repeated
    rows are packed as often as they come; a group of copies or a hot source takes as many bins as it has pieces; an
    empty table gives no bins. Other columns are not looked at.

    Pieces are dealt out by a hash of document and piece into shards of about ``shard_rows`` pieces, each packed in one
    task; a source or cluster of any share is spread over all shards. Shards depend on the data only.
    """
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity)))
    narrow = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"),
                          F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster")).filter("n_tokens > 0")
    total = narrow.agg(F.count("*").alias("n"), F.sum(F.floor((F.col("n_tokens") - 1) / capacity) + 1).alias("p")).first()["p"] or 0
    shards = max(1, -(-int(total) // shard_rows))
    cut = narrow.withColumn("piece", pieces).withColumn(
        "n_tokens", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), "doc_id long, n_tokens long, source string, cluster string, piece long, shard long, bin long").select(
        "shard", "bin", "doc_id", "piece", "n_tokens", "source", "cluster")
