"""Registered queries of the training-data operators: thin forms over whole tables, with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .centroids import CLUSTERS_SQL, cluster_vectors
from .debruijn import remove_repeats
from .decontaminate import find_leaks
from .languages import identify_languages
from .licenses import find_licenses
from .lines import LINES_SQL, drop_boilerplate, host_of, html_lines
from .minhash import NEAR, near_duplicates
from .packing import pack
from .pii import digest as pii_digest
from .pii import find_pii
from .prefix_trie import TRIE_SQL, prefix_trie
from .quality import quality
from .rollups import bpe_counter, commit_batch, totals, word_counter
from .secrets import digest as secret_digest
from .secrets import find_secrets
from .shared import likely_in, written

#: Vocabulary file of the byte-pair tokenizer, at the same place on every executor.
BPE_FILE = os.environ.get("BPE_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, all spans with those of the tagger."""
    return pii_digest(find_pii(_table(spark, folder, "documents")))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Text of all pages without the boilerplate lines of their host, with the numbers of lines and dropped lines."""
    pages = _table(spark, folder, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_boilerplate(pages, "host", "text").select(
        "page_id", "host", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(_table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into bins by their number of words; a cluster are near-duplicates of a similarity of 0.8 or more.

    A document without an id takes part in clusters under a hash of its text.
    """
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("node"))
    found = near_duplicates(docs, id_col="node", **NEAR, carry=("doc_id", "source"))
    return pack(written(found.select("carried.*", F.col("n_words").alias("n_tokens"), F.col("component_id").alias("cluster")), "items"))


def op5_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, after three batches of changes.

    The first inserts all documents; the second deletes those labelled as of no quality and revises those labelled as
    toxic, here to lower case; the third is the second again, as after a failed driver.
    """
    store = f"{shared_dir(spark).rstrip('/')}/rollups-{uuid.uuid4().hex}"
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    counters = [word_counter("words"), bpe_counter(BPE_FILE, "byte_bpe_50k")]
    commit_batch(spark, store, 1, docs.select("doc_id", F.lit(False).alias("deleted"), "text", "source", "lang"), counters)
    marked = written(labels.filter("quality = 0 OR toxic = 1").groupBy("doc_id").agg(F.min("quality").alias("quality")), "marked")
    second = likely_in(docs, marked, "doc_id").join(marked, "doc_id").select("doc_id", (F.col("quality") == 0).alias("deleted"), F.lower("text").alias("text"), "source", "lang")
    for _ in range(2):
        commit_batch(spark, store, 2, second, counters)
    return totals(spark, store)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without words of 13-word windows that a smaller document has: numbers of words and a digest of the rest."""
    return remove_repeats(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices and texts in all documents: doc_id, license, coverage, place."""
    return find_licenses(_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures, perplexity band and verdict of all documents."""
    return quality(_table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Test items found in all documents: doc_id, item_id, distance in words, where the passage ends."""
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents: counts and digest of base spans, spans with live-looking tokens, live and copied ones."""
    return secret_digest(find_secrets(_table(spark, folder, "documents")))


def op11_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out: doc_id, held_out, lang_pred, score, ambiguous."""
    return identify_languages(_table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations: members, children, leaves, repeated words, digest of those that end there."""
    return prefix_trie(_table(spark, folder, "conversations"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all embeddings of 64 components after five rounds: nearest centroid, distance, inertia."""
    return cluster_vectors(_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_minhash, op4_packing, op5_token_rollups, op6_substring_dedup, op7_licenses, op8_quality, op9_decontamination,
                                   op10_secrets, op11_languages, op12_prefix_trie, op13_centroids, pipeline)}


def checks() -> dict[str, str]:
    return {"op2_line_dedup": LINES_SQL, "op12_prefix_trie": TRIE_SQL, "op13_centroids": CLUSTERS_SQL}
