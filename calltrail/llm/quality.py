"""Quality rules: base figures of every text and bands of n-gram perplexity per language.

Perplexity is that of the word trigrams of ``word_model``. The model of the characters of words below (modified
Kneser-Ney, Chen & Goodman, 1999; ``fit_model`` and ``score``) can be used apart from it: Spark counts the n-grams of the
highest order over all words of all documents; lower orders are continuation counts of that table, discounts come from
its counts of counts. Scoring looks n-grams up in sorted arrays of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .word_model import word_surprise
from .words import Words, find_words, inside_rows, mix, row_blocks, window_hashes, word_hashes

ORDER = 4
#: A language's band below and above its median log perplexity of a word, in robust standard deviations, and the least such
#: deviation. Set on labelled rows: junk lies high; near copies, of which one must stay, vouch for each other and lie low.
BELOW, ABOVE, LEAST_SPREAD = 20.0, 2.2, 0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Arrays up to this size are sent to every task; a larger model is joined instead.
MODEL_BYTES = 64 << 20
SYMBOLS = b"#*$%&|<>"  # fixed values: the symbols that count
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
_BEGIN, _END = 1, 2
_BLOCK = 4 << 20
_TYPES = 400_000


def _lang_key(lang: str) -> np.uint64:
    return mix(np.array([hash_text(lang)], np.uint64))[0]


def hash_text(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int(window_hashes(codes + np.uint64(1), len(codes))[0]) if len(codes) else 0


def _letters(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each led by ``order - 1`` begin marks and closed by an end mark; number of n-grams of each word."""
    lead, close = chr(_BEGIN) * (order - 1), chr(_END)
    texts = [w.decode("utf-8", "replace") for w in words]
    codes = np.frombuffer((lead + (close + lead).join(t.replace("\x01", "�").replace("\x02", "�") for t in texts) + close).encode("utf-32-le"), np.uint32)
    return codes, np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def _gram_starts(codes: np.ndarray, order: int) -> np.ndarray:
    """Where the n-grams of words begin: their last character is no begin mark."""
    return np.flatnonzero(codes[order - 1:] != _BEGIN)


def _distinct(words: Words, rows: np.ndarray, hashes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words among those of ``rows`` (a mask of words): bytes, counts and the index of each word in them."""
    at = np.flatnonzero(rows)
    _, first, inverse, counts = np.unique(hashes[at], return_index=True, return_inverse=True, return_counts=True)
    raw = words.data.tobytes()
    begin, end = words.starts[at[first]].tolist(), words.ends[at[first]].tolist()
    return [raw[b:e] for b, e in zip(begin, end)], counts, inverse


def _languages(part: pa.RecordBatch, words: Words) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a slice and the mask of its words."""
    counts = np.diff(words.first)
    langs = np.array([x or "" for x in part.column(part.schema.get_field_index("lang")).to_pylist()], dtype=object)
    for lang in sorted(set(langs)):
        yield lang, np.repeat(langs == lang, counts)


def _count_grams(order: int):
    def emit(types: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, known in types.items():
            codes, lengths = _letters(list(known), order)
            weights = np.repeat(np.fromiter(known.values(), np.int64, len(known)), lengths)
            starts = _gram_starts(codes, order)
            hashes = window_hashes(codes.astype(np.uint64) + np.uint64(1), order)[starts]
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, weights=weights).astype(np.int64)
            grams = np.stack([codes[starts[first] + k] for k in range(order)], 1)
            texts = np.ascontiguousarray(grams).view(f"<U{order}").ravel()
            yield pa.record_batch({"lang": pa.array([lang] * len(counts), pa.string()), "gram": pa.array(texts.tolist(), pa.string()), "c": pa.array(counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text", _BLOCK):
                words = find_words(data, offsets)
                hashes = word_hashes(words)
                for lang, mask in _languages(part, words):
                    if mask.any():
                        known = types.setdefault(lang, {})
                        found, counts, _ = _distinct(words, mask, hashes)
                        for w, c in zip(found, counts.tolist()):
                            known[w] = known.get(w, 0) + c
                if sum(map(len, types.values())) > _TYPES:
                    yield from emit(types)
                    types = {}
        yield from emit(types)
    return run


class Model(NamedTuple):
    """Log probabilities of n-grams and log weights of contexts, by order: (lang, gram, lp) and (lang, gram, bow)."""

    probabilities: list[DataFrame]  # of order 1 first
    weights: list[DataFrame]  # of the contexts of order 1 (empty text) first
    unseen: DataFrame  # (lang, lp): a character that was never seen
    order: int


def fit_model(docs: DataFrame, order: int = ORDER) -> Model:
    """Count and fit one model per language over all words of ``docs`` (text, lang; NULL lang is a language of its own)."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    top = written(rows.mapInArrow(_count_grams(order), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
    tables = [top]
    for _ in range(order - 1):
        tables.insert(0, tables[0].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c")))
    tables = [written(t, "grams") if k < order - 1 else t for k, t in enumerate(tables)]
    letters = tables[0].groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("uniform"))
    probabilities, weights = [], []
    below = letters.select("lang", F.lit("").alias("gram"), F.log("uniform").alias("lp"))
    unseen = below.select("lang", "lp")
    for n, table in enumerate(tables, 1):
        kinds = table.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(float(k) - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(0.5 * k)
        discounts = kinds.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
        cut = table.join(discounts, "lang").withColumn("ctx", F.substring("gram", 1, n - 1)).withColumn(
            "d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = cut.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        fitted = (cut.withColumn("rest", F.substring("gram", 2, order)).join(contexts, ["lang", "ctx"])
                  .join(below.select("lang", F.col("gram").alias("rest"), F.col("lp").alias("lower")), ["lang", "rest"]))
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.exp("lower")
        below = written(fitted.select("lang", "gram", F.log(p).alias("lp")), "model")
        probabilities.append(below)
        weights.append(written(contexts.select("lang", F.col("ctx").alias("gram"), F.log("gamma").alias("bow")), "model"))
        if n == 1:
            below = below.select("lang", "gram", "lp")
    return Model(probabilities, weights, unseen, order)


class _Arrays(NamedTuple):
    keys: list[np.ndarray]
    values: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_values: list[np.ndarray]
    unseen: dict[str, float]


def _sorted_arrays(table: DataFrame, size: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = table.select("lang", "gram", value).toArrow()
    langs, grams = got.column("lang").to_pylist(), got.column("gram").to_pylist()
    seeds = {x: _lang_key(x) for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    if size:
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
        keys = np.zeros(len(codes), np.uint64) if not len(codes) else window_hashes(codes.ravel() + np.uint64(1), size)[::size]
    else:
        keys = np.zeros(len(grams), np.uint64)
    keys = mix(keys ^ seed) if len(keys) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column(value).to_numpy()[order].astype(np.float64)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def _log_probabilities(codes: np.ndarray, starts: np.ndarray, lang: str, model: _Arrays, order: int) -> np.ndarray:
    """Of each n-gram, backing off to shorter ones where it was never seen."""
    seed = _lang_key(lang)
    out = np.zeros(len(starts))
    left = np.arange(len(starts))
    letters = codes.astype(np.uint64) + np.uint64(1)
    for n in range(order, 0, -1):
        begin = starts[left] + (order - n)
        grams = mix(window_hashes(letters, n)[begin] ^ seed)
        value, seen = _find(model.keys[n - 1], model.values[n - 1], grams)
        out[left[seen]] += value[seen]
        left, begin = left[~seen], begin[~seen]
        if not len(left):
            return out
        contexts = mix((window_hashes(letters, n - 1)[begin] if n > 1 else np.zeros(len(left), np.uint64)) ^ seed)
        value, seen = _find(model.context_keys[n - 1], model.context_values[n - 1], contexts)
        out[left[seen]] += value[seen]
    out[left] += model.unseen.get(lang, 0.0)
    return out


def _base_figures(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, counts = words.data, np.diff(words.first)
    rows = len(counts)
    owner = np.repeat(np.arange(rows), counts)
    by_row = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), words.offsets))
    lengths = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    # Words in 3-word windows that occur twice or more in their row.
    at = np.flatnonzero(inside_rows(words.first, 3))
    windows = mix(window_hashes(hashes, 3)[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    covered = np.zeros(len(hashes), bool)
    again = at[_repeated(windows)]
    for k in range(3):
        covered[again + k] = True
    # Lines with a word that equal an earlier line of their row.
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.unique(np.concatenate([breaks[:-1] + 1, words.offsets[:-1]]))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(words.offsets, starts, side="right") - 1
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], words.offsets[line_row + 1])
    with_word = np.append(words.starts, len(data))[np.searchsorted(words.starts, starts)] < ends
    starts, ends, line_row = starts[with_word], ends[with_word], line_row[with_word]
    # Only lines that are as long as another line of their row and begin like it are hashed whole.
    salt = line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    head = word_hashes(Words(data, starts, np.minimum(ends, starts + 16), words.first, words.offsets))
    like = np.sort(_repeated(mix(mix(head + (ends - starts).astype(np.uint64)) + salt)))
    starts, ends, line_row = starts[like], ends[like], line_row[like]
    lines = mix(word_hashes(Words(data, starts, ends, words.first, words.offsets), 4096) + salt[like])
    _, first = np.unique(lines, return_index=True)
    extra = np.ones(len(lines), bool)
    extra[first] = False
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": np.diff(lengths[words.first]) - by_row((data & 0xC0) == 0x80),
        "n_symbols": by_row(IS_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[extra], minlength=rows),
        "n_repeat_words": np.bincount(owner[covered], minlength=rows),
    }


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Where the keys are that occur twice or more, in no order."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return order[np.append(same, False) | np.append(False, same)] if len(keys) else order


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _figures(model, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(*model.value) if model is not None else None  # plain arrays travel
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text", _BLOCK if arrays is not None else _BLOCK // 4):
                words = find_words(data, offsets)
                hashes = word_hashes(words)
                figures = _base_figures(words, hashes)
                lp, n_grams = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
                if arrays is not None:
                    for lang, mask in _languages(part, words):
                        if mask.any():
                            found, _, inverse = _distinct(words, mask, hashes)
                            codes, lengths = _letters(found, order)
                            each = _log_probabilities(codes, _gram_starts(codes, order), lang, arrays, order)
                            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                            lp[mask], n_grams[mask] = np.add.reduceat(each, first)[inverse], lengths[inverse]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (lp, n_grams)]
                total, grams = (s[words.first[1:]] - s[words.first[:-1]] for s in sums)
                columns = [part.column(0), part.column(part.schema.get_field_index("lang")), *[pa.array(figures[k].astype(np.int64)) for k in FIGURES], pa.array(-total), pa.array(grams.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *FIGURES, "surprise", "n_grams"])
    return run


def _gram_rows(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, lang in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
                found = [w for w in found if w]
                if found:
                    codes, _ = _letters(found, order)
                    starts = _gram_starts(codes, order)
                    grams = np.ascontiguousarray(np.stack([codes[starts + k] for k in range(order)], 1)).view(f"<U{order}").ravel()
                    grams, counts = np.unique(grams, return_counts=True)
                    yield pa.record_batch({"key": pa.array([key] * len(grams), pa.string()), "lang": pa.array([lang or ""] * len(grams), pa.string()), "gram": pa.array(grams.tolist(), pa.string()), "n": pa.array(counts.astype(np.int64))})
    return run


def _joined_surprise(docs: DataFrame, model: Model) -> DataFrame:
    """(key, surprise, n_grams) with the model as tables: every n-gram of a document meets its probability in a join."""
    now = docs.mapInArrow(_gram_rows(model.order), "key string, lang string, gram string, n long").withColumns({"lp": F.lit(0.0), "seen": F.lit(False)})
    for n in range(model.order, 0, -1):
        found = model.probabilities[n - 1].withColumnRenamed("lp", "p")
        context = model.weights[n - 1].select("lang", F.col("gram").alias("ctx"), "bow")
        now = now.join(found, ["lang", "gram"], "left").withColumn("ctx", F.substring("gram", 1, n - 1)).join(context, ["lang", "ctx"], "left")
        add = F.when(F.col("seen"), 0.0).otherwise(F.coalesce("p", "bow", F.lit(0.0)))
        now = now.select("key", "lang", F.substring("gram", 2, model.order).alias("gram"), "n", (F.col("lp") + add).alias("lp"), (F.col("seen") | F.col("p").isNotNull()).alias("seen"))
    rest = model.unseen.withColumnRenamed("lp", "p")
    now = now.join(rest, "lang", "left").withColumn("lp", F.col("lp") + F.when(F.col("seen"), 0.0).otherwise(F.coalesce("p", F.lit(0.0))))
    return now.groupBy("key").agg((-F.sum(F.col("lp") * F.col("n"))).alias("surprise"), F.sum("n").alias("n_grams"))


def score(docs: DataFrame, model: Model, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, lang, base figures, surprise (negative log probability) and n_grams of each row.

    The arrays of a model of at most ``model_bytes`` go to every task; beyond that n-grams are joined with the model's
    tables, which gives the same figures.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{k} long' for k in FIGURES)}, surprise double, n_grams long"
    size = 16 * sum(t.count() for t in (*model.probabilities, *model.weights))
    if size <= model_bytes:
        parts = [_sorted_arrays(t, n, "lp") for n, t in enumerate(model.probabilities, 1)]
        contexts = [_sorted_arrays(t, n, "bow") for n, t in enumerate(model.weights)]
        unseen = {r["lang"]: r["lp"] for r in model.unseen.collect()}
        arrays = spark.sparkContext.broadcast(([k for k, _ in parts], [v for _, v in parts], [k for k, _ in contexts], [v for _, v in contexts], unseen))
        return narrow.mapInArrow(_figures(arrays, model.order), schema)
    keyed = narrow.withColumn("key", F.concat_ws("-", F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce("lang", F.lit(""))))
    texts = keyed.dropDuplicates(["key"]).select("key", "text", "lang")
    figures = keyed.select(F.struct("doc_id", "key").alias("doc_id"), "text", "lang").mapInArrow(
        _figures(None, model.order), f"doc_id struct<doc_id: {kind}, key: string>, lang string, {', '.join(f'{k} long' for k in FIGURES)}, surprise double, n_grams long")
    return (figures.drop("surprise", "n_grams").withColumn("key", F.col("doc_id.key")).withColumn("doc_id", F.col("doc_id.doc_id"))
            .join(_joined_surprise(texts, model), "key", "left").drop("key").na.fill({"surprise": 0.0, "n_grams": 0}))


def word_scores(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base figures, surprise and n_grams (words) of each row, by the model of word trigrams without the row's own text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    keyed = narrow.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))))
    figures = keyed.select(F.struct("doc_id", "key").alias("doc_id"), "text", "lang").mapInArrow(
        _figures(None, ORDER), f"doc_id struct<doc_id: {kind}, key: long>, lang string, {', '.join(f'{k} long' for k in FIGURES)}, surprise double, n_grams long")
    return (figures.drop("surprise", "n_grams").withColumn("key", F.col("doc_id.key")).withColumn("doc_id", F.col("doc_id.doc_id"))
            .join(word_surprise(keyed.select("key", "text", "lang")), "key", "left").drop("key").na.fill({"surprise": 0.0, "n_grams": 0}))


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
            below: float = BELOW, above: float = ABOVE, least_spread: float = LEAST_SPREAD) -> DataFrame:
    """doc_id, base figures, base_failed, log_perplexity, low, high, kept for each row of ``docs`` (doc_id, text, lang).

    A row fails the base rules with fewer than ``min_words`` words, or with more than ``max_repeat_percent`` percent of
    its words in 3-word windows that it repeats. The others of a language give the band: median of the log perplexity
    per word with a letter or digit, less ``below`` and plus ``above`` robust deviations (quartile range / 1.349, at least ``least_spread``).
    A row is kept if it passes both; one without any letter or digit has no perplexity and is not kept.

    Cases: NULL, empty and blank texts have zero words and fail. NULL languages form one language. A language of one
    document keeps it. Repeated rows and equal texts get equal verdicts; NULL ids are treated like others; an empty table
    gives no rows. Further columns are not looked at.
    """
    scored = written(word_scores(docs), "scores")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lp = F.when(F.col("n_grams") > 0, F.col("surprise") / F.col("n_grams"))
    scored = scored.withColumns({"base_failed": base, "log_perplexity": lp, "language": F.coalesce("lang", F.lit(""))})
    # Exact quartiles of values rounded to four decimals: a language comes to one task as the counts of at most some 300,000 of them.
    rounded = scored.filter("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("language", F.round("log_perplexity", 4).alias("x")).agg(F.count("*").alias("n"))
    quartiles = rounded.groupBy("language").agg(F.percentile("x", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    spread = F.greatest(F.lit(least_spread), (F.col("q")[2] - F.col("q")[0]) / 1.349)
    bands = quartiles.select("language", (F.col("q")[1] - below * spread).alias("low"), (F.col("q")[1] + above * spread).alias("high"))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return (scored.join(bands, "language", "left")
            .select("doc_id", *FIGURES, "base_failed", "log_perplexity", "low", "high", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")))
