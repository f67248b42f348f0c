"""Language identification by error-correcting output codes over hashed n-grams.

Every language has a codeword of +1 and -1. For each place of the codewords a binary classifier (logistic regression over
n-grams of bytes) tells the languages with +1 there from those with -1. A text's margins are compared with all
codewords; each place counts for a language as much as its classifier was right on that language's texts that it was not
trained on. The least loss wins, and a runner-up close behind it marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import mix, row_blocks

#: Bounds of the fit: most frequent languages that are learned, and distinct texts that are learned from, shared equally by the languages.
MOST_LANGUAGES, SAMPLE_TEXTS = 64, 4000
#: Bytes of n-grams, and bins they are hashed to.
GRAMS, BINS = (1, 2, 3, 4), 4096
#: All dichotomies are used for up to so many languages, else about 10 log2(languages) places.
EXHAUSTIVE = 6
#: A text is ambiguous if its winner's share of the decoding is below it.
LEAST_SHARE = 0.6
UNKNOWN = "und"
_HELD, _FOLDS = 2, 4
_ROUNDS, _RATE, _DECAY, _SCALE = 150, 0.05, 1e-4, 8.0
_SALTS = 256
_ROWS = 256
# Bytes of text whose n-grams are hashed at once.
_PIECE = 1 << 20
# Letters stay, in lower case; other ASCII characters are spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x places, +1 or -1
    weights: np.ndarray  # places x (bins + 1), the last one is the intercept
    trust: np.ndarray  # languages x places


def codewords(n: int) -> np.ndarray:
    """A codeword of each of ``n`` languages: all splits for few, else a far-apart one of some random codes (fixed seed)."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(n)
    best, apart = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        distance = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + np.eye(n, dtype=np.int32) * 10_000
        if distance.min() > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, int(distance.min())
    return best


def gram_features(data: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Square roots of the shares of hashed n-grams in each row of lower-cased text, as unit vectors. Runs of spaces count as one."""
    text = _PLAIN[data]
    rows = len(offsets) - 1
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(text)]] = True
    first = np.concatenate([[0], np.cumsum([np.count_nonzero(keep[a:b]) for a, b in zip(offsets, offsets[1:])], dtype=np.int64)]) if rows else np.zeros(1, np.int64)
    text = text[keep]
    out = np.zeros((rows, bins), np.float32)
    counts = np.zeros(rows * bins, np.int64)
    for at in range(0, len(text), _PIECE):
        piece = np.concatenate([text[at:at + _PIECE + max(GRAMS) - 1], np.zeros(8, np.uint8)])
        eights = np.ndarray(shape=(len(piece) - 8,), dtype="<u8", buffer=piece, strides=(1,))
        owner = np.searchsorted(first, np.arange(at, at + len(eights)), side="right") - 1
        for n in GRAMS:
            last = min(_PIECE, len(eights) - n + 1)  # grams that begin in this piece
            if last <= 0:
                continue
            whole = owner[:last] == owner[n - 1:n - 1 + last]
            grams = (eights[:last][whole] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 40)
            found = (mix(grams) & np.uint64(bins - 1)).astype(np.int64)
            counts += np.bincount(owner[:last][whole] * bins + found, minlength=rows * bins)
    np.sqrt(counts.reshape(rows, bins), out=out, casting="unsafe")
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _feature_blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    at = batch.schema.get_field_index("text")
    low = batch.set_column(at, "text", pc.utf8_lower(batch.column(at)))
    for start in range(0, low.num_rows, _ROWS):
        for part, data, offsets in row_blocks(low.slice(start, _ROWS), "text"):
            yield part, gram_features(data, offsets)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, x in _feature_blocks(batch):
            yield pa.record_batch({"mark": part.column("mark"), "lang": part.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def fit_bits(x: np.ndarray, signs: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Weights (places x features + 1) of logistic regressions of ``signs`` (rows x places), by Adam on all rows."""
    w = np.zeros((signs.shape[1], x.shape[1] + 1), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    scaled = _SCALE * x
    for t in range(1, _ROUNDS + 1):
        margin = scaled @ w[:, :-1].T + w[:, -1]
        pull = (-signs * balance / (1 + np.exp(np.clip(signs * margin, -30, 30)))).astype(np.float32)
        grad = np.concatenate([pull.T @ scaled + _DECAY * w[:, :-1], pull.sum(0)[:, None]], 1)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= _RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w


def margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _SCALE * x @ weights[:, :-1].T + weights[:, -1]


def train(x: np.ndarray, lang: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, weights and trust from features and language numbers. Trust is measured on a fifth that other weights were fitted without."""
    code = codewords(n)
    signs = code[lang].astype(np.float32)
    counts = np.bincount(lang, minlength=n)
    balance = (len(lang) / (n * counts[lang]))[:, None] / len(lang)
    apart = np.arange(len(lang)) % 5 == 0
    trust = np.full(code.shape, 0.5)
    if (~apart).any() and apart.any():
        trial = fit_bits(x[~apart], signs[~apart], balance[~apart])
        right = margins(x[apart], trial) * signs[apart] > 0
        for k in range(n):
            mine = right[lang[apart] == k]
            trust[k] = (mine.sum(0) + 0.5) / (len(mine) + 1)
    return code, fit_bits(x, signs, balance), trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)


def decode(margin: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number of least weighted logistic loss for each row of margins, and its share: a softmax of the losses."""
    signed = np.clip(margin[:, None, :] * code[None, :, :], -30, 30)
    loss = (trust[None] * np.log1p(np.exp(-signed))).sum(2) * max(1, code.shape[1])
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return best, 1 / share.sum(1)


def _train(languages: list[str]):
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("mark", "lang", "x")))]
        rows.sort(key=lambda r: (r[0], r[1]))
        if rows:
            x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1)
            code, weights, trust = train(x, np.array([number[r[1]] for r in rows]), len(languages))
            yield pa.record_batch({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "trust": pa.array([trust.tobytes()], pa.binary())})
    return run


def fit_languages(docs: DataFrame, most_languages: int = MOST_LANGUAGES, sample_texts: int = SAMPLE_TEXTS) -> Model | None:
    """A model of the languages of ``docs`` (doc_id, text, lang): rows with a language, letters and an id that is not held out.

    The sample has the distinct texts of smallest hash, equally many of each language at most; NULL without any.
    """
    spark = docs.sparkSession
    usable = docs.filter(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(_FOLDS)) != _HELD) & F.col("lettered"))
    keyed = usable.select("doc_id", "lang", F.xxhash64("text").alias("mark"))
    texts = written(keyed.groupBy("lang", "mark").agg(F.min("doc_id").alias("doc_id")), "texts")
    top = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in top.collect())
    if not languages:
        return None
    each = max(1, sample_texts // len(languages))

    def smallest(rows: DataFrame, *keys: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("mark", "doc_id"))
        return rows.withColumn("nth", nth).filter(F.col("nth") <= each).drop("nth")

    # First within parts of a language, so that a language of most texts is no single task's.
    parted = smallest(texts.filter(F.col("lang").isin(languages)).withColumn("salt", F.pmod("mark", F.lit(_SALTS))), "lang", "salt")
    chosen = written(smallest(parted, "lang").drop("salt"), "sample")
    # At most ``sample_texts`` ids.
    rows = usable.withColumn("mark", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "lang", "mark"]).dropDuplicates(["lang", "mark"])
    features = written(rows.select("mark", "lang", "text").mapInArrow(_features, "mark long, lang string, x binary"), "features")
    fitted = features.coalesce(1).mapInArrow(_train(languages), "weights binary, trust binary").collect()
    weights = np.frombuffer(fitted[0]["weights"], np.float32).reshape(-1, BINS + 1)
    return Model(languages, codewords(len(languages)), weights, np.frombuffer(fitted[0]["trust"]).reshape(len(languages), -1))


def _predict(model: Model, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            for part, x in _feature_blocks(batch):
                best, share = decode(margins(x, model.weights), model.code, model.trust)
                known = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                                       "lang_pred": pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                                       "score": pa.array(np.where(known, share, 0.0)), "ambiguous": pa.array(~known | (share < least_share))})
    return run


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES,
                       sample_texts: int = SAMPLE_TEXTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous.

    Learned from texts with letters, a language and an id with crc32(decimal id) % 4 other than 2 (those with 2 are
    held out); predicted from the whole text alone. score is the winner's share in decoding, ambiguous says that it is below
    ``least_share``. Texts without letters are ``und`` with score 0 and ambiguous.

    Cases: NULL, empty and letterless texts are ``und``; a NULL id is neither learned from nor held out; rows without a language
    are only predicted; one learned language is predicted for every text with letters, none leaves all ``und``;
    repeated rows and copies of a text count once in learning and get equal predictions; an empty table gives no rows.
    Other columns are not looked at.

    One pass over the documents predicts; the model, of a few thousand weights for each place of the code, goes with the tasks.
    """
    text = F.col(text_col).cast("string")
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(_FOLDS)) == _HELD, F.lit(False))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    model = fit_languages(slim, most_languages, sample_texts)
    rows = slim.drop("lang")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    return rows.mapInArrow(_predict(model, least_share), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
