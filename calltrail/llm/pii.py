"""Personal data in whole texts: base patterns, and spans that a character-level BiLSTM with a CRF adds to them."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tagger import Params, best_path, emissions, joined_path, symbols, train

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and between window starts.
WIDTH, STEP = 96, 48
#: Bound of the training sample, in windows with labelled spans and in windows without; made-up windows fill it up.
LABELLED, UNLABELLED, WINDOWS = 600, 200, 2800
#: Characters that are scored together; a longer stretch is scored in blocks of windows, one path runs through them all.
STRETCH = 1 << 15
N_TAGS = 1 + 2 * len(KINDS)

# The base patterns. Each is written so that a scan stays linear: a run of digits is only entered at its
# start, and the local part of an address is found backwards from its sign.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0  # end of the last match, or just behind the last sign
    for m in _AT.finditer(text):
        lead = text[max(done, text.rfind("@", done, m.start()) + 1):m.start()]
        start = m.start() - (len(lead) - len(lead.rstrip(_LOCAL)))
        if start < m.start():
            done = m.end()
            yield start, m.end()


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by kind and start; failing ones are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _TRIGGER.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of overlapping windows that hold a digit or an at sign; a span without either is none of the kinds."""
    out: list[list[int]] = []
    last = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < last:
            continue
        low = max(0, (at - WIDTH) // STEP + 1) * STEP  # first window that holds it
        high = at // STEP * STEP + WIDTH  # end of the last one
        last = at // STEP * STEP + STEP  # up to here the same windows hold further ones
        if out and low < out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, min(b, len(text))) for a, b in out]


_SCAN = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))),
                   ("stretches", pa.list_(pa.struct([("s", pa.int64()), ("text", pa.string())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            base, seen = [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base.append([{"kind": k, "s": s, "e": e} for k, s, e in base_spans(text)])
                seen.append([{"s": a, "text": text[a:b]} for a, b in stretches(text)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(base, _SCAN.field("base").type), pa.array(seen, _SCAN.field("stretches").type)], schema=_SCAN)


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _card_number(rng: np.random.Generator, n: int = 16) -> str:
    head = "4" + _number(rng, n - 2)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def variant(kind: int, rng: np.random.Generator) -> tuple[str, str, str]:
    """A made-up item of a kind, in one of its written forms, with what stands right before and after it."""
    w = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(0, len(x))]
    if kind == 0:
        return "", f"{w(2, 9)}{pick('', '.', '_', '+')}{pick(w(1, 6), _number(rng, 2))}@{w(3, 9)}{pick('', _number(rng, 1))}.{pick('example.', '')}{pick('com', 'org', 'net', 'de')}", ""
    if kind == 1:
        ip = ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
        return "", ip, pick("", "", ":" + _number(rng, 4))
    if kind == 2:
        digits = _card_number(rng, pick(16, 16, 16, 19))
        sep = pick("", " ", "-")
        return "", sep.join(digits[k:k + 4] for k in range(0, len(digits), 4)), pick("", "", f" {_number(rng, 2)}/{_number(rng, 2)}")
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return "", pick(f"+{_number(rng, 1)} ({a}) {b}-{c}", f"+{_number(rng, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_number(rng, 2)}{a}{b}{c}"), ""


def distractor(rng: np.random.Generator) -> str:
    """Digits and signs that are none of the kinds."""
    pick = lambda *x: x[rng.integers(0, len(x))]
    hexed = "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, rng.integers(24, 41)))
    return pick(f'token = "{hexed}"', hexed, _number(rng, rng.integers(1, 9)), f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}",
                f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{rng.integers(1, 999)}.{rng.integers(0, 99):02d}", f"{rng.integers(1, 99)} @ {rng.integers(1, 99)}", f"@{hexed[:5]}", _number(rng, rng.integers(22, 30)))


def training_windows(rows: list[tuple[str, list[Span]]], seed: int = 7, made_up: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows: the labelled stretches, the same with their spans rewritten in other forms or replaced
    by distractors, and ``made_up`` windows of random words (as many as fill up ``WINDOWS``, 800 at least), so that a
    table without personal data trains too."""
    rng = np.random.default_rng(seed)
    texts: list[tuple[str, list[Span]]] = list(rows)
    for text, spans in rows:
        for k, s, e in spans[:2]:
            before, item, after = variant(k, rng)
            texts.append((text[:s] + before + item + after + text[e:], [(k, s + len(before), s + len(before) + len(item))] + [(x, a, b) for x, a, b in spans if b <= s]))
            texts.append((text[:s] + distractor(rng), [(x, a, b) for x, a, b in spans if b <= s]))
    for i in range(max(800, WINDOWS - len(texts)) if made_up is None else made_up):
        words = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 10))) for _ in range(rng.integers(1, 9)))
        lead = words() + " "
        if i % 3:
            k = int(rng.integers(0, len(KINDS)))
            before, item, after = variant(k, rng)
            texts.append((lead + before + item + after + rng.choice(["", ".", ",", ")"]) + " " + words(), [(k, len(lead) + len(before), len(lead) + len(before) + len(item))]))
        else:
            texts.append((lead + distractor(rng) + " " + words(), []))
    ids, tags = [], []
    for text, spans in texts:
        row, tag = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
        # The window lies anywhere around the first span, so that spans are cut by edges too.
        low = max(0, (spans[0][1] - int(rng.integers(0, WIDTH))) if spans else int(rng.integers(0, max(1, len(text) - WIDTH + 1))))
        piece = symbols(text[low:low + WIDTH])
        row[:len(piece)] = piece
        for k, s, e in spans:
            a, b = max(0, s - low), min(WIDTH, e - low)
            if a < b:
                tag[a:b] = 2 + 2 * k
                if s >= low:
                    tag[a] = 1 + 2 * k
        ids.append(row)
        tags.append(tag)
    return np.array(ids), np.array(tags)


def _spans_of(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    for t in np.flatnonzero(tags).tolist():
        tag = int(tags[t])
        kind = (tag - 1) // 2
        if tag % 2 == 0 and out and out[-1][0] == kind and out[-1][2] == t:
            out[-1] = (kind, out[-1][1], t + 1)
        else:
            out.append((kind, t, t + 1))
    return out


_TENT = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)


def _window_scores(ids: list[np.ndarray], places: list[tuple[int, int]], p: Params) -> np.ndarray:
    block = np.zeros((len(places), WIDTH), np.int64)
    for r, (i, a) in enumerate(places):
        piece = ids[i][a:a + WIDTH]
        block[r, :len(piece)] = piece
    return emissions(block, p)


def _starts(length: int) -> range:
    return range(0, max(1, length - WIDTH + STEP), STEP)


def _score_blocks(text: str, p: Params, rows: int) -> Iterator[np.ndarray]:
    """Averaged scores of one stretch, a block of windows after the other; what the next block adds to is handed over."""
    ids, starts = symbols(text), _starts(len(text))
    sums, weights, done = np.zeros((0, N_TAGS), np.float32), np.zeros(0, np.float32), 0
    for at in range(0, len(starts), rows):
        some = starts[at:at + rows]
        grown = min(len(text), some[-1] + WIDTH) - done - len(sums)
        sums, weights = np.concatenate([sums, np.zeros((grown, N_TAGS), np.float32)]), np.concatenate([weights, np.zeros(grown, np.float32)])
        scores = _window_scores([ids], [(0, a) for a in some], p)
        for r, a in enumerate(some):
            n = min(WIDTH, len(text) - a)
            sums[a - done:a - done + n] += scores[:n, r] * _TENT[:n, None]
            weights[a - done:a - done + n] += _TENT[:n]
        ready = len(sums) if at + rows >= len(starts) else some[-1] + STEP - done
        yield sums[:ready] / weights[:ready, None]
        sums, weights, done = sums[ready:], weights[ready:], done + ready


def tag_stretches(texts: list[str], p: Params, rows: int = 512, together: int = STRETCH) -> list[list[Span]]:
    """Spans of each stretch: windows are scored on their own, scores of overlapping windows are averaged with weights that
    fall towards a window's edges, and one best path runs through the whole stretch, however long it is. Stretches above
    ``together`` characters are scored block by block, which gives the same scores in less memory."""
    out: list[list[Span]] = [[] for _ in texts]
    for i, t in enumerate(texts):
        if len(t) > together:
            out[i] = _spans_of(joined_path(_score_blocks(t, p, rows), p))
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= together]
    ids = [symbols(texts[i]) for i in short]
    sums = [np.zeros((len(x), N_TAGS), np.float32) for x in ids]
    weights = [np.zeros(len(x), np.float32) for x in ids]
    places = [(k, a) for k, x in enumerate(ids) for a in _starts(len(x))]
    for at in range(0, len(places), rows):
        some = places[at:at + rows]
        scores = _window_scores(ids, some, p)
        for r, (k, a) in enumerate(some):
            n = min(WIDTH, len(ids[k]) - a)
            sums[k][a:a + n] += scores[:n, r] * _TENT[:n, None]
            weights[k][a:a + n] += _TENT[:n]
    for k, i in enumerate(short):
        out[i] = _spans_of(best_path(sums[k] / weights[k][:, None], p))
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether a span that the model proposes has the make-up of its kind; what passes is kept as proposed."""
    digits = _DIGITS.sub("", text)
    if kind == 0:
        name, sign, host = text.partition("@")
        return bool(name and sign and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host)) and not set(name) - set(_LOCAL)
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and not re.search(r"[^0-9 -]", text) and luhn(digits)
    return 8 <= len(digits) <= 15 and len(text) > len(digits) and not re.search(r"[^0-9 ().+-]", text) and text[0] in "+(0123456789" and text[-1].isdigit()


def settled(kind: int, text: str) -> int | None:
    """The kind whose make-up a proposed span has: its own first, then card, ip, email, phone; None without one."""
    return next((k for k in (kind, 2, 1, 0, 3) if plausible(k, text)), None)


def _added(params):
    schema = pa.schema([("row_key", pa.int64()), ("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = params.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, rows = part.column("text").to_pylist(), []
                for text, spans, start, key, base in zip(texts, tag_stretches(texts, p), part.column("s").to_pylist(), part.column("row_key").to_pylist(), part.column("base").to_pylist()):
                    for k, a, b in spans:
                        a += len(text[a:b]) - len(text[a:b].lstrip(" \n\t"))
                        b -= len(text[a:b]) - len(text[a:b].rstrip(" \n\t.,;"))
                        clash = any(start + a < x["e"] and x["s"] < start + b for x in base)
                        # Not a part of a longer run of digits or letters.
                        alone = (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "-.")) and (b >= len(text) or not text[b].isalnum())
                        kind = settled(k, text[a:b]) if b > a and alone and not clash else None
                        if kind is not None:
                            rows.append((key, kind, start + a, start + b))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def fit_tagger(scanned: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, seed: int = 7) -> Params:
    """Train on a bounded sample: ``labelled`` stretches with base spans and ``unlabelled`` without, the first by a hash."""
    rows = scanned.select("row_key", "base", F.explode("stretches").alias("x")).select("row_key", "base", "x.s", F.col("x.text").alias("text")).filter(F.length("text") <= 4096)
    inside = F.filter("base", lambda b: (b["s"] >= F.col("s")) & (b["e"] <= F.col("s") + F.length("text")))
    rows = rows.withColumn("base", inside).withColumn("h", F.xxhash64("row_key", "s"))
    # Without a base span, many digits may still be personal data in a form the patterns miss: no example of its absence.
    clear = (F.length(F.regexp_replace("text", "[^0-9]", "")) < 8) & ~F.contains("text", F.lit("@"))
    rows = rows.filter((F.size("base") > 0) | clear).select("h", "s", "text", "base", (F.size("base") > 0).alias("spans"))
    sample = [rows.filter(F.col("spans") == found).orderBy("h", "s", "text").limit(bound) for found, bound in ((True, labelled), (False, unlabelled))]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = [r for batch in batches for r in batch.to_pylist()]
        picked = [(r["text"], sorted(((b["kind"], b["s"] - r["s"], b["e"] - r["s"]) for b in r["base"]), key=lambda x: x[1])) for r in sorted(picked, key=lambda r: (r["h"], r["s"], r["text"]))]
        raw = io.BytesIO()
        np.savez(raw, **train(*training_windows(picked, seed), N_TAGS))
        yield pa.record_batch({"params": pa.array([raw.getvalue()], pa.binary())})

    # One task trains on the bounded sample, with the one thread that Spark gives a task's numpy.
    trained = sample[0].unionAll(sample[1]).coalesce(1).mapInArrow(fit, "params binary").first()
    with np.load(io.BytesIO(trained["params"])) as made:
        return dict(made)


def find_pii(docs: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, base (kind, s, e) and added (kind, s, e) for each row of ``docs`` (doc_id, text); places in code points.

    Base spans are the matches of the fixed patterns. The model reads the stretches of windows that hold a digit or an at
    sign, and adds spans that overlap no base span, stand alone and have the make-up of their kind: forms that the
    patterns leave out or run past. It is trained in one task on a sample bounded by ``labelled`` and ``unlabelled``
    windows; everything else is one pass over whole texts.

    Cases: NULL is an empty text; empty texts have no spans; overlaps between kinds stay, each kind is judged alone;
    repeated rows get equal spans; NULL ids are returned as such; an empty table gives no rows and still trains on made-up
    windows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.withColumn("row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kinds = "array<struct<kind: int, s: bigint, e: bigint>>"
    scanned = written(keyed.mapInArrow(_scan, f"doc_id long, row_key long, base {kinds}, stretches array<struct<s: bigint, text: string>>"), "scanned")
    params = spark.sparkContext.broadcast(fit_tagger(scanned, labelled, unlabelled))
    parts = scanned.select("row_key", "base", F.explode("stretches").alias("x")).select("row_key", "base", "x.s", F.col("x.text").alias("text"))
    added = parts.mapInArrow(_added(params), "row_key long, kind int, s long, e long")
    added = added.groupBy("row_key").agg(F.collect_set(F.struct("kind", "s", "e")).alias("added"))
    return scanned.select("doc_id", "row_key", "base").join(added, "row_key", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(kinds)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans (all of them, as kind:start:end)."""
    shown = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"], x["e"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
