"""Secrets in whole texts, and how widely each candidate is shared: copied examples against live-looking credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex", "token")
#: A value in more repositories, or of more owners, than these is a copied example.
MAX_REPOSITORIES, MAX_OWNERS = 10, 3
#: Bits a character of a token that the base patterns leave out.
LEAST_ENTROPY = 3.5

# The base patterns.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_KEYWORD = re.compile(r"(?i:pass|secret|token|api)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Further candidates: long tokens of letters and digits.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")

Found = tuple[int, int, int, str]  # kind, start, end, value


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def base_spans(text: str) -> list[Found]:
    """Matches of the base patterns by start, then kind; failing ones are dropped."""
    out: list[Found] = []
    if _KEYWORD.search(text):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def further_tokens(text: str, base: list[Found], least_entropy: float = LEAST_ENTROPY) -> list[Found]:
    """Long tokens with letters and digits and high entropy that overlap no base span."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t) and entropy(t) >= least_entropy and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            out.append((3, m.start(), m.end(), t))
    return out


_FOUND = pa.list_(pa.struct([("s", pa.int64()), ("kind", pa.int32()), ("e", pa.int64()), ("value", pa.string())]))
_FOUND_SQL = "array<struct<s: bigint, kind: int, e: bigint, value: string>>"


def _scan(least_entropy: float):
    schema = pa.schema([("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("found", _FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    # The value itself stays here: its digest identifies it.
                    rows.append([{"s": s, "kind": k, "e": e, "value": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32]} for k, s, e, v in base + further_tokens(text or "", base, least_entropy)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("repository"), part.column("owner"), pa.array(rows, _FOUND)], schema=schema)
    return run


def ownership(candidates: DataFrame, max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """value, n_repositories, n_owners, widely_copied for (value, repository, owner); counts are of distinct names.

    Pairs are made distinct first, so a value that a third of the corpus copies reaches its group as partial counts.
    """
    pairs = candidates.select("value", "repository", "owner").distinct()
    repositories = pairs.select("value", "repository").distinct().groupBy("value").agg(F.count("repository").alias("n_repositories"))
    owners = pairs.select("value", "owner").distinct().groupBy("value").agg(F.count("owner").alias("n_owners"))
    return repositories.join(owners, "value").withColumn("widely_copied", (F.col("n_repositories") > max_repositories) | (F.col("n_owners") > max_owners))


def find_secrets(docs: DataFrame, repository: str | None = None, owner: str = "source", max_repositories: int = MAX_REPOSITORIES,
                 max_owners: int = MAX_OWNERS, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """doc_id and found for each row of ``docs``: s, kind, e, value (digest), n_repositories, n_owners, widely_copied of each candidate.

    Kinds 0 to 2 are the base patterns; kind 3 are further long tokens of high entropy. A candidate is widely copied when
    its value is in more than ``max_repositories`` repositories or belongs to more than ``max_owners`` owners. Documents are no
    repositories, so without a column ``repository`` owners decide alone and n_repositories is 0: a credential of one owner
    stays live in any number of copies.

    Cases: NULL is an empty text; NULL repositories and owners count as none; repeated rows get equal results and count
    once; NULL ids are returned as such; an empty table gives no rows. Other columns are not looked at.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(repository) if repository else F.lit(None)).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    scanned = written(narrow.mapInArrow(_scan(least_entropy), f"doc_id long, repository string, owner string, found {_FOUND_SQL}").withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = scanned.filter(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("x")).select("row", "repository", "owner", "x.*")
    judged = each.join(ownership(each, max_repositories, max_owners), "value")
    grouped = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e", "value", "n_repositories", "n_owners", "widely_copied"))).alias("found"))
    return scanned.filter(F.size("found") > 0).select("row", "doc_id").join(grouped, "row").select("doc_id", "found").unionAll(
        scanned.filter(F.size("found") == 0).select("doc_id", F.array().cast(grouped.schema["found"].dataType).alias("found")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, spans (with added tokens that look live), live and copied candidates."""
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"], x["e"])), ",")
    base = F.filter("found", lambda x: x["kind"] < 3)
    spans = F.filter("found", lambda x: (x["kind"] < 3) | ~x["widely_copied"])
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"),
                        F.size(F.filter("found", lambda x: ~x["widely_copied"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda x: x["widely_copied"])).cast("long").alias("n_copied"))
