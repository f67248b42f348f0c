"""Substring search in a stored request table through an index of three-byte sequences to files (B2).

The index lies below the table, in ``_grams``, beside the key index and built in the same batches. For each file and
searched column it holds which of the 2^24 sequences of three bytes occur in its texts (UTF-8, A-Z lower-cased): a row
(column, bucket, file, bits) for each 2^15 of them, 4 kB at most, sorted by column and bucket. It is exact, so a file that
lacks one sequence of the term cannot hold the term. Files that may hold it are read and filtered as a scan would be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import search_requests
from .lookup import _files, _index, _quoted, _read
from .tables import load_table

#: The columns a search looks through.
SEARCHED = ("input_messages", "output_message", "model")
#: Sequences of a bucket; 4 kB of bits, the width that Spark's bitmap functions merge.
BUCKET = 1 << 15
#: Bytes of text that are turned into sequences at once.
_STEP = 1 << 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ROWS = "path string, column string, bucket int, bits binary"


def _codes(data: np.ndarray) -> np.ndarray:
    """The three bytes from each place of ``data`` as one number."""
    folded = _FOLD[data].astype(np.int32)
    return (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]


def _mark(seen: np.ndarray, texts: pa.Array) -> None:
    """Set what occurs in ``texts``, step by step, whatever the length of one; sequences across two texts do not count."""
    texts = pc.cast(texts.drop_null(), pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    edges = offsets[1:-1]
    for lo in range(int(offsets[0]), int(offsets[-1]), _STEP):
        hi = min(lo + _STEP + 2, int(offsets[-1]))
        if hi - lo < 3:
            continue
        inside = np.ones(hi - lo - 2, bool)
        near = edges[(edges > lo) & (edges < hi)] - lo
        for back in (1, 2):
            at = near - back
            inside[at[(at >= 0) & (at < len(inside))]] = False
        seen[_codes(data[lo:hi])[inside]] = True


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each file, column and bucket in use; what a task has seen of one file at a time is kept, 16 MB a column."""
    path, seen = None, {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, marks in seen.items():
            blocks = marks.reshape(-1, BUCKET)
            used = np.flatnonzero(blocks.any(1))
            bits = [np.packbits(blocks[k], bitorder="little").tobytes() for k in used]
            yield pa.record_batch({"path": pa.array([path] * len(used), pa.string()), "column": pa.array([name] * len(used), pa.string()),
                                   "bucket": pa.array(used.astype(np.int32)), "bits": pa.array(bits, pa.binary())})

    for batch in batches:
        files = batch.column("path")
        for file in pc.unique(files).to_pylist():
            if file != path:
                yield from rows()
                path, seen = file, {}
            part = batch.filter(pc.equal(files, file))
            for name in part.schema.names[1:]:
                _mark(seen.setdefault(name, np.zeros(1 << 24, bool)), part.column(name))
    yield from rows()


def update_text_index(spark: SparkSession, store: str, columns: tuple[str, ...] = SEARCHED) -> int:
    """Index the files that no batch covers yet, as one batch more; how many those were. One writer at a time.

    Tasks send bits, not text: at most 512 buckets of 4 kB for a file and column, merged by partial aggregation.
    """
    done, covered = _index(spark, store, "_grams")
    new = {k: f for k, f in _files(spark, store).items() if k not in covered}
    if not new:
        return 0
    home = f"{store.rstrip('/')}/_grams/batch={len(done)}"
    log = spark.read.schema(load_table(spark, store).schema).option("basePath", store).parquet(*new.values())
    found = log.select(F.col("_metadata.file_path").alias("path"), *columns).mapInArrow(_bitmaps, _ROWS)
    name = store.rstrip("/").rsplit("/", 1)[-1]
    rows = (found.groupBy("column", "bucket", F.element_at(F.split("path", f"/{_quoted(name)}/"), -1).alias("file"))
            .agg(F.bitmap_or_agg("bits").alias("bits")))
    (rows.repartitionByRange("column", "bucket", "file").sortWithinPartitions("column", "bucket", "file")
     .write.mode("overwrite").parquet(f"{home}/part"))
    spark.createDataFrame([(f,) for f in new], "file string").write.mode("overwrite").parquet(f"{home}/files")
    return len(new)


def sequences(term: str) -> list[int]:
    """Sequences of three bytes that every text with the term holds: those of the runs between its wildcards."""
    runs = [np.frombuffer(r.encode("utf-8"), np.uint8) for r in re.split("[%_]", term)]
    return sorted({int(c) for r in runs if len(r) > 2 for c in _codes(r)})


def files_of_term(spark: SparkSession, store: str, term: str) -> list[str]:
    """Files of the table that may hold the term in one of the searched columns. File names, not rows, come to the driver."""
    current = _files(spark, store)
    wanted = sequences(term)
    done, covered = _index(spark, store, "_grams")
    if not wanted or not done:
        return [current[f] for f in sorted(current)]
    chosen = {f for f in current if f not in covered}
    index = (spark.read.schema("column string, bucket int, file string, bits binary")
             .parquet(*[f"{store.rstrip('/')}/_grams/batch={n}/part" for n in done])
             .filter(F.col("bucket").isin(sorted({c // BUCKET for c in wanted}))))
    bits = spark.createDataFrame([(c // BUCKET, c % BUCKET) for c in wanted], "bucket int, bit int")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = index.join(bits, "bucket").filter(F.getbit(byte, F.col("bit") % 8) == 1).groupBy("column", "file").agg(F.count("*").alias("n"))
    chosen |= {r["file"] for r in held.filter(F.col("n") == len(wanted)).select("file").distinct().collect()} & set(current)
    return [current[f] for f in sorted(chosen)]


def search_stored(spark: SparkSession, store: str, term: str) -> DataFrame:
    """Rows of the table at ``store`` that :func:`~calltrail.operators.filters.search_requests` finds, from the files that may hold them.

    It spares the files that hold no text with all sequences of the term: ids, names, addresses and rare words lie in
    few files, frequent words in all. Cases: ``%`` and ``_`` are wildcards, only the runs between them are looked up; a term
    without a run of three bytes, a table without index, and files the index does not cover are read whole, so the rows are
    the same; NULL texts hold nothing; the empty term finds every row with a text.
    """
    return search_requests(_read(spark, store, files_of_term(spark, store, term)), term)
