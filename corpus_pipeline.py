"""From raw documents to packed training sequences: quality rules, line dedup, near-dup removal, decontamination, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.llm.decontaminate import find_leaks
from calltrail.llm.lines import drop_boilerplate
from calltrail.llm.minhash import NEAR, near_duplicates
from calltrail.llm.packing import pack, word_count
from calltrail.llm.quality import quality
from calltrail.llm.shared import free_name, likely_in, without, written
from calltrail.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    Verdicts are looked up by doc_id: rows that share an id go if one of them is rejected. A row with a NULL id is no
    document and goes.
    """
    named = docs.filter("doc_id IS NOT NULL")
    rejected = quality(named).filter("NOT kept").select("doc_id").distinct()
    return without(named, written(rejected, "rejected"), "doc_id")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    A document that would lose all its lines stays whole: a large group of copies makes all its lines frequent, and near-dedup
    must find it to keep one of them.
    """
    n_lines, n_dropped = free_name(docs, "_n_lines"), free_name(docs, "_n_dropped")
    left = drop_boilerplate(docs, "source", "text", keep_emptied=True, n_lines=n_lines, n_dropped=n_dropped)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(n_dropped) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity of 0.8 or more), the one with the smallest doc_id; of repeated rows one."""
    dropped = near_duplicates(docs, **NEAR).filter("NOT kept").select("doc_id").distinct()
    left = without(docs, written(dropped, "copies"), "doc_id")
    repeated = written(left.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    once = likely_in(left, repeated, "doc_id").join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return without(left, repeated, "doc_id").unionAll(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item of ``benchmark`` occurs within its error budget."""
    leaks = find_leaks(docs, _read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, written(leaks, "leaks"), "doc_id")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the bins they share: shard, bin, doc_id, piece, n_tokens, source, cluster."""
    items = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), "source", F.sha2("text", 256).alias("cluster"))
    return pack(items)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: The perplexity model, Jaccard components, edit matching and packing are no SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet to the shared folder and read by the next stage."""
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
