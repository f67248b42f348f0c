"""Token counts as rollups kept by signed changes: by source, language and tokenizer version, with idempotent batches.

A store is a folder of three tables. ``ledger/batch=N`` holds, for each changed document and tokenizer version, the count
before and after; ``deltas/batch=N`` the signed sums of these rows by source, language and version; ``commits/batch=N`` marks
a batch as done once both are complete. Totals add up the deltas of committed batches and never look at documents again,
so a batch that is committed again, or was left half written, changes nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import likely_in
from .words import find_words, row_blocks

#: Characters that a tokenizer gets at once; longer texts are cut where its pieces part anyway, in front of white space.
PIECE = 1 << 20
_CUT = re.compile(r"(?<=\S)\s")
# Fixed value: the pattern by which the byte-pair vocabularies split a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Counter = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
STATE = "source string, lang string, version string, tokens bigint"
LEDGER = "doc_id bigint, version string, before struct<source: string, lang: string, tokens: bigint>, after struct<source: string, lang: string, tokens: bigint>"
DELTA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"
_encodings: dict = {}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in parts that have, together, the tokens of the whole."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def word_counter(version: str = "words") -> Counter:
    """Counts words parted by ASCII white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                counts = find_words(data, offsets).first
                yield pa.record_batch({"doc_id": part.column("doc_id"), "source": part.column("source"), "lang": part.column("lang"), "version": pa.array([version] * part.num_rows, pa.string()), "tokens": pa.array((counts[1:] - counts[:-1]).astype("int64"))})
    return run


def bpe_counter(path: str, version: str) -> Counter:
    """Counts tokens of a byte-pair vocabulary, a file of base64 tokens and ranks that every executor has at ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = _encodings.get(path)
        if encoding is None:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "lang": batch.column("lang"), "version": pa.array([version] * len(counts), pa.string()), "tokens": pa.array(counts, pa.int64())})
    return run


def _batches(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{store}/{table}").parquet(f"{store}/{table}")
    except AnalysisException as absent:
        if absent.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def committed(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the batches that are done."""
    marks = _batches(spark, store, "commits")
    return sorted(r["batch"] for r in marks.select(F.col("batch").cast("long")).distinct().collect()) if marks is not None else []


def ledger(spark: SparkSession, store: str, below: int | None = None) -> DataFrame:
    """Ledger rows of committed batches (before batch ``below``), with their batch."""
    done = [b for b in committed(spark, store) if below is None or b < below]
    if not done:
        return spark.createDataFrame([], LEDGER + ", batch bigint")
    return spark.read.option("basePath", f"{store}/ledger").parquet(*[f"{store}/ledger/batch={b}" for b in done]).withColumn("batch", F.col("batch").cast("long"))


def commit_batch(spark: SparkSession, store: str, batch: int, changes: DataFrame, counters: list[Counter]) -> bool:
    """Apply a batch of changes; false if it was committed before, which leaves everything as it is.

    ``changes``: doc_id, deleted (boolean), text, source, lang, and optionally seq. A document that is not deleted is
    inserted, or revised if the store has it: its old count is taken off, also under another source or language. Of
    several changes of a document the one with the largest seq counts, then the one that deletes, then the largest text.
    Batches come in rising order; a new one below a committed one is an error.

    Cases: NULL texts have no tokens; NULL sources and languages are groups of their own; deleting an unknown document
    changes nothing; rows with a NULL id are left out, as they could not be revised; an empty batch is a batch. Other
    columns are not looked at.
    """
    done = committed(spark, store)
    if batch in done:
        return False
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}")
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("text").cast("string").alias("text"),
                          F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), seq.alias("seq")).filter("doc_id IS NOT NULL")
    # Counting comes first and drops the texts: only numbers are shuffled. A digest of the text breaks ties.
    marked = rows.withColumn("key", F.struct("doc_id", "deleted", "seq", F.xxhash64("text").alias("mark")))
    counted = None
    for counter in counters:
        part = marked.filter("NOT deleted").select(F.col("key").alias("doc_id"), "text", "source", "lang").mapInArrow(
            counter, f"doc_id struct<doc_id: bigint, deleted: boolean, seq: bigint, mark: bigint>, {STATE}")
        counted = part if counted is None else counted.unionAll(part)
    inserted = counted.select("doc_id.*", "source", "lang", "version", "tokens")
    old = ledger(spark, store, batch)
    ids = rows.select("doc_id").distinct()
    known = likely_in(old, ids, "doc_id") if done else old
    state = known.groupBy("doc_id", "version").agg(F.max_by("after", "batch").alias("before")).filter("before IS NOT NULL")
    gone = rows.filter("deleted").select("doc_id", "deleted", "seq", F.lit(None).cast("bigint").alias("mark")).join(
        state.select("doc_id", "version").union(inserted.select("doc_id", "version")).distinct(), "doc_id")
    removed = gone.select("doc_id", "deleted", "seq", "mark", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), "version", F.lit(None).cast("bigint").alias("tokens"))
    last = inserted.unionAll(removed).groupBy("doc_id", "version").agg(F.max_by(F.struct("deleted", "source", "lang", "tokens"), F.struct("seq", "deleted", F.coalesce("mark", F.lit(0)))).alias("x"))
    after = F.when(~F.col("x.deleted"), F.struct(F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.tokens").alias("tokens")))
    part = last.join(state, ["doc_id", "version"], "left").select("doc_id", "version", "before", after.alias("after")).filter("before IS NOT NULL OR after IS NOT NULL")
    part.write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}")
    signed_sums(spark.read.schema(part.schema).parquet(f"{store}/ledger/batch={batch}")).write.mode("overwrite").parquet(f"{store}/deltas/batch={batch}")
    spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{store}/commits/batch={batch}")
    return True


def signed_sums(rows: DataFrame) -> DataFrame:
    """source, lang, version, n_docs, n_tokens: what ledger rows add to each group, less what they take off; no group without change."""
    signed = rows.select("version", F.inline(F.array(
        F.struct(F.col("after").alias("x"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("before").alias("x"), F.lit(-1).cast("long").alias("sign"))))).filter("x IS NOT NULL")
    sums = signed.groupBy("x.source", "x.lang", "version").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("x.tokens")).alias("n_tokens"))
    return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, version, n_docs, n_tokens: the sums of the deltas of all committed batches, without empty groups."""
    done = committed(spark, store)
    if not done:
        return spark.createDataFrame([], DELTA)
    deltas = spark.read.schema(DELTA).parquet(*[f"{store}/deltas/batch={b}" for b in done])
    return (deltas.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0"))
