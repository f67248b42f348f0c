"""Perplexity of texts under a modified Kneser-Ney model of word trigrams, one for each language, each text left out of its own model.

Counts of the highest order are those of texts, lower orders are continuation counts. A text that was counted itself would
vouch for its own rare words, so a trigram's probability is that of the model without one text that holds it: it depends on
the trigram alone.

The trigrams of all texts at once would take many times the disk of the texts. So Spark deals them out to cells, which are
handled in passes over the texts, a fixed number of them whatever the input, and each pass gives its shuffle files back.
The first passes count, with trigrams dealt by their last word: counts of counts, pairs and what precedes a last word are
whole in a cell. The second ones score, dealt by middle word: all contexts and pairs of a word meet in one cell. What else such a
cell has to know, the counts of its last words, the counting cells have written for it. Trigrams travel as packed columns, one
row for each cell and block of text; words that are frequent in a sample are numbers of two bytes there, others their
hashes. The sample decides about bytes only, never about results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import split_likely, written
from .words import find_words, mix, row_blocks, word_hashes

_SPOKEN = np.zeros(256, bool)
_SPOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BEGIN = mix(np.ones(1, np.uint64))[0]
#: Passes over the texts that count and that score; cells of one scoring pass at least. None of them changes a result.
COUNT_PASSES, SCORE_PASSES, MIN_CELLS = 3, 4, 32
#: Words sent as numbers, the number of all others, and how many rows are sampled to choose them.
_NUMBERED, _SAMPLE_ROWS = 65535, 4000
_RARE = np.uint16(_NUMBERED)
_SLOT_BITS = 20
#: A word that would fill more than so many cells is split by its other words.
FULL_CELLS = 1
_BLOCK = 2 << 20
#: Distinct trigrams whose probabilities are computed at once, and words for other cells that a task keeps before it writes them.
_AT_ONCE, _HELD = 1 << 17, 1 << 20

#: Keys and languages of rows; row and middle word of each trigram; its first word, last word and weight at some places.
Occurrences = tuple[np.ndarray, list[str], np.ndarray, np.ndarray, tuple[Callable[[np.ndarray], np.ndarray], ...]]
Source = Callable[[pa.RecordBatch], Iterator[Occurrences]]

_PACKED = {k: "binary" for k in ("a", "b", "c", "rare_a", "rare_b", "rare_c", "n", "keys", "runs")}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in ({"lang": "string", "cell": "int"} | _PACKED).items())
#: Rows of the counting passes: counts of counts (order in cell; in last: 0 their sum, 5 those above two), counts of frequent last
#: words, what follows split words (as in ``_context``), and, packed for a scoring cell, counts of its last words and of its pairs of split words.
_COUNTS, _FREQUENT, _FOLLOWED, _SINGLES, _PAIRS = range(5)
_COUNTED = "kind int, lang string, cell int, last long, n long, rare_b binary, rare_c binary, counts binary"


class Plan(NamedTuple):
    """What all tasks know: number of cells, frequent words (sorted by slot, one a slot), over how many cells each is split."""

    cells: int
    words: np.ndarray
    splits: np.ndarray

    def slots(self) -> np.ndarray:
        at = np.full(1 << _SLOT_BITS, _RARE, np.uint16)
        at[self.words >> np.uint64(64 - _SLOT_BITS)] = np.arange(len(self.words), dtype=np.uint16)
        return at

    def by_number(self) -> np.ndarray:
        return np.append(self.words, np.zeros(_NUMBERED + 1 - len(self.words), np.uint64))

    def numbers(self, words: np.ndarray, slots: np.ndarray, by_number: np.ndarray) -> np.ndarray:
        number = slots[words >> np.uint64(64 - _SLOT_BITS)]
        number[by_number[number] != words] = _RARE
        return number

    def dealer(self) -> Callable[[np.ndarray, Callable[[np.ndarray], np.ndarray]], np.ndarray]:
        """Gives cells by a word; those of a split word by another one, too (given by a function of places)."""
        heavy, over = self.words[self.splits > 1], self.splits[self.splits > 1].astype(np.uint64)
        mark = np.zeros(1 << _SLOT_BITS, np.uint16)
        mark[heavy >> np.uint64(64 - _SLOT_BITS)] = np.arange(1, len(heavy) + 1, dtype=np.uint16)

        def cells(word: np.ndarray, other: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            out = word >> np.uint64(2)
            at = np.flatnonzero(mark[word >> np.uint64(64 - _SLOT_BITS)]) if len(heavy) else []
            if len(at):
                which = mark[word[at] >> np.uint64(64 - _SLOT_BITS)] - 1
                hit = heavy[which] == word[at]
                at, which = at[hit], which[hit]
                out[at] += mix(other(at) + _PRIME) % over[which]
            return (out % np.uint64(self.cells)).astype(np.int64)
        return cells


class Level(NamedTuple):
    """Of one language: what follows the empty context (total, one, two, more) and the discounts of each order (0, then of one, two and more)."""

    all1: tuple[float, ...]
    d1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray


@lru_cache(4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _of_texts(batch: pa.RecordBatch) -> Iterator[Occurrences]:
    """Trigrams of each row; two begin marks lead a row.

    Words without letter or digit are in the model, but have no weight in a text's score: as every other word of a table
    they are so likely that the table would pass for prose.
    """
    for part, data, offsets in row_blocks(batch, "text", _BLOCK):
        words = find_words(data, offsets)
        if not len(words.starts):
            continue
        counts, first = np.diff(words.first), words.first
        owner = np.repeat(np.arange(len(counts)), counts)
        langs = part.column("lang").to_pylist()
        salt = np.array([_salt(x) for x in langs], np.uint64)
        begin = _BEGIN ^ salt
        c = word_hashes(words) ^ np.repeat(salt, counts)
        b = np.roll(c, 1)
        b[first[:-1][counts > 0]] = begin[counts > 0]

        def before_last(at: np.ndarray, c=c, owner=owner, first=first, begin=begin) -> np.ndarray:
            of = owner[at]
            return np.where(at - first[of] > 1, c[at - 2], begin[of])

        def spoken(at: np.ndarray, data=data, words=words) -> np.ndarray:
            out = _SPOKEN[data[words.starts[at]]]
            left = np.flatnonzero(~out)
            left = left[words.ends[at[left]] - words.starts[at[left]] > 1]
            if len(left):
                so_far = np.flatnonzero(_SPOKEN[data])
                begin = np.searchsorted(so_far, words.starts[at[left]])
                out[left] = np.append(so_far, len(data))[begin] < words.ends[at[left]]
            return out

        yield part.column("key").to_numpy(), langs, owner, b, (before_last, c.__getitem__, spoken)


def _of_trigrams(batch: pa.RecordBatch) -> Iterator[Occurrences]:
    """Every row (key, lang, a, b, c) as a text of one trigram."""
    langs = batch.column("lang").to_pylist()
    salt = np.array([_salt(x) for x in langs], np.uint64)
    a, b, c = (mix(batch.column(k).to_numpy().view(np.uint64)) ^ salt for k in "abc")
    yield batch.column("key").to_numpy(), langs, np.arange(len(a)), b, (a.__getitem__, c.__getitem__, np.ones(len(a), bool).__getitem__)


class Groups(NamedTuple):
    """Equal keys: where one of each is, how often each is there, and the group of every key."""

    at: np.ndarray
    counts: np.ndarray
    of: np.ndarray


def _grouped(keys: np.ndarray) -> Groups:
    """As ``np.unique``, but by numpy's quicksort, which is several times as fast as the stable sort it takes for indices."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    starts = np.flatnonzero(new)
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return Groups(order[starts], np.diff(np.append(starts, len(keys))), of)


def _hash(*columns: np.ndarray) -> np.ndarray:
    out = columns[0].astype(np.uint64)
    for x in columns[1:]:
        out = mix(out * _PRIME + x)
    return out


def _column(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each size: so many of the values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(source: Source, plan: Plan, low: int, high: int, scoring: bool):
    """Distinct trigrams of each row in the cells from ``low`` to ``high``, a row for each language and cell.

    For scoring they are dealt by middle word and have keys and weights, for counting by last word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, by_number, cells = plan.slots(), plan.by_number(), plan.dealer()
        for batch in batches:
            if not batch.num_rows:
                continue
            for keys, langs, owner, b, (a_at, c_at, weight_at) in source(batch):
                cell = cells(b, a_at) if scoring else cells(c_at(slice(None)), b.__getitem__)
                here = np.flatnonzero((cell >= low) & (cell < high))
                if not len(here):
                    continue
                owner, b, cell, a, c = owner[here], b[here], cell[here], a_at(here), c_at(here)
                weight = weight_at(here) if scoring else np.ones(len(here), bool)
                names, code = np.unique(np.array(langs, object), return_inverse=True)
                group = code[owner] * plan.cells + cell
                # One sort by cell, row and, in the bits that are left, trigram.
                place = group * len(langs) + owner
                bits = np.uint64(64 - int(len(names) * plan.cells * len(langs)).bit_length())
                order = np.argsort((place.astype(np.uint64) << bits) | (_hash(a, b, c) >> (np.uint64(64) - bits)))
                owner, a, b, c, weight, group, place = (x[order] for x in (owner, a, b, c, weight, group, place))
                new = np.append(True, (place[1:] != place[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(new))) * weight[at]
                owner, a, b, c, group = (x[at] for x in (owner, a, b, c, group))
                first = np.append(True, group[1:] != group[:-1])
                starts = np.flatnonzero(first)
                sizes = np.diff(np.append(starts, len(at)))
                out = {"lang": pa.array(names[group[starts] // plan.cells].tolist(), pa.string()), "cell": pa.array((group[starts] % plan.cells).astype(np.int32))}
                numbers = {k: plan.numbers(x, slots, by_number) for k, x in (("a", a), ("b", b), ("c", c))}
                out |= {k: _column(x, sizes) for k, x in numbers.items()}
                for k, x in (("a", a), ("b", b), ("c", c)):
                    rare = numbers[k] == _RARE
                    out[f"rare_{k}"] = _column(x[rare], np.add.reduceat(rare.astype(np.int64), starts))
                if scoring:
                    turn = first | np.append(True, owner[1:] != owner[:-1])
                    runs = np.flatnonzero(turn)
                    per = np.add.reduceat(turn.astype(np.int64), starts)
                    out["n"] = _column(n.astype(np.uint32), sizes)
                    out["keys"] = _column(keys[owner[runs]], per)
                    out["runs"] = _column(np.diff(np.append(runs, len(at))).astype(np.uint32), per)
                else:
                    out |= {k: pa.nulls(len(starts), pa.binary()) for k in ("n", "keys", "runs")}
                yield pa.record_batch(out)
    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """Language, cell and rows of each cell; the rows come sorted by language and cell."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, cells = batch.column("lang").dictionary_encode(), batch.column("cell").to_numpy()
        code = langs.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(cells)]
        for begin, end in zip(cuts, cuts[1:]):
            key = (langs.dictionary[int(code[begin])].as_py(), int(cells[begin]))
            if held and key != now:
                yield *now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield *now, pa.Table.from_batches(held)


def _values(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    """The values of packed rows, one row's behind the other's."""
    parts = [np.zeros(0, kind)]
    for x in rows.column(column).chunks:
        x = x.fill_null(b"") if x.null_count else x
        if len(x):
            ends = np.frombuffer(x.buffers()[1], np.int32)[[x.offset, x.offset + len(x)]]
            if ends[1] > ends[0]:
                parts.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0]:ends[1]].copy().view(kind))
    return np.concatenate(parts)


def _words(rows: pa.Table, plan: Plan, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of the words of a cell."""
    number = _values(rows, name, np.uint16)
    words = np.append(plan.words, np.uint64(0))[np.minimum(number, len(plan.words))]
    words[number == _RARE] = _values(rows, f"rare_{name}", np.uint64)
    return words, number


def _counted(plan: Plan):
    """Counts of counts, of last words and of the pairs of split words; cells come by last word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {k: pa.binary() for k in ("rare_b", "rare_c", "counts")}

        def rows(kind: int, lang: str, cell, last, n) -> pa.RecordBatch:
            n = np.asarray(n, np.int64)
            full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n.shape).astype(t))
            return pa.record_batch({"kind": full(kind, np.int32), "lang": pa.array([lang] * len(n), pa.string()), "cell": full(cell, np.int32), "last": full(last, np.int64),
                                    "n": pa.array(n), **{k: pa.nulls(len(n), t) for k, t in empty.items()}})

        def packed(kind: int, lang: str, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            """One row for each scoring cell: its words (pairs of words) and their counts."""
            target, b, c, n = (np.concatenate(x) for x in zip(*parts))
            if not len(target):
                return
            order = np.argsort(target, kind="stable")
            at, sizes = np.unique(target, return_counts=True)
            none = pa.nulls(len(at), pa.int64())
            words = {"rare_b": _column(b[order], sizes) if kind == _PAIRS else pa.nulls(len(at), pa.binary()), "rare_c": _column(c[order], sizes), "counts": _column(n[order].astype(np.uint32), sizes)}
            yield pa.record_batch({"kind": pa.array(np.full(len(at), kind, np.int32)), "lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at.astype(np.int32)), "last": none, "n": none, **words})

        frequent: dict[str, np.ndarray] = {}
        held: dict[tuple[int, str], list[tuple[np.ndarray, ...]]] = {}
        cells, split = plan.dealer(), np.append(plan.splits > 1, False)
        for lang, _, table in _cells(batches):
            (a, _), (b, mid), (c, last) = (_words(table, plan, k) for k in "abc")
            del table
            at, texts, _ = _grouped(_hash(a, b, c))
            a, b, c, mid, last = (x[at] for x in (a, b, c, mid, last))
            at, before, pair = _grouped(_hash(b, c))
            frequent[lang] = frequent.get(lang, 0) + np.bincount(last[at], minlength=_NUMBERED + 1)[:_NUMBERED]
            rare = np.flatnonzero(last[at] == _RARE)
            _, firsts, word = _grouped(c[at[rare]])
            for order, counts in ((3, texts), (2, before), (1, firsts)):
                yield rows(_COUNTS, lang, order, range(6), [counts.sum(), *np.bincount(np.minimum(counts, 5), minlength=6)[1:5], (counts > 2).sum()])
            single = np.ones(len(at), np.int64)
            single[rare] = firsts[word]
            # Every scoring cell with a trigram learns what it cannot count itself: counts above one.
            ask = {_SINGLES: np.flatnonzero((single > 1)[pair])}
            heavy = split[np.minimum(mid, len(plan.splits))]
            if heavy.any():
                ask[_PAIRS] = np.flatnonzero(heavy & (before > 1)[pair])
                of = at[heavy[at]]
                first, _, word = _grouped(b[of])
                yield rows(_FOLLOWED, lang, np.repeat(range(4), len(first)), np.tile(b[of][first].view(np.int64), 4), np.concatenate(_context(word, before[heavy[at]])))
            for kind, places in ask.items():
                to = cells(b[places], a[places].__getitem__)
                once = _grouped(_hash(to, c[places]) if kind == _SINGLES else _hash(to, b[places], c[places])).at
                places, to = places[once], to[once]
                parts = held.setdefault((kind, lang), [])
                parts.append((to, b[places] if kind == _PAIRS else c[:0], c[places], (single if kind == _SINGLES else before)[pair[places]]))
                if sum(len(x[0]) for x in parts) > _HELD:
                    yield from packed(kind, lang, parts)
                    parts.clear()
        for (kind, lang), parts in held.items():
            if parts:
                yield from packed(kind, lang, parts)
        for lang, counts in frequent.items():
            at = np.flatnonzero(counts)
            yield rows(_FREQUENT, lang, 0, plan.words[at].view(np.int64), counts[at])
    return run


def _context(inverse: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """What follows a context: the sum of its counts, and how many of them are one, two and more."""
    return np.bincount(inverse, counts), *(np.bincount(inverse, x) for x in (counts == 1, counts == 2, counts > 2))


def _smoothed(count: np.ndarray, context: tuple, discounts: np.ndarray, gone: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probability of an n-gram in its context; where ``gone`` one of its counts is taken off first."""
    off = [(gone & (count == k)).astype(np.int64) for k in (1, 2, 3)]
    total, one, two, more = context
    left, total = count - gone, total - gone
    one, two, more = one - off[0] + off[1], two - off[1] + off[2], more - off[2]
    own = left - discounts[np.minimum(left, 3)]
    rest = (discounts[1] * one + discounts[2] * two + discounts[3] * more) * lower
    return np.where(total > 0, (own + rest) / np.maximum(total, 1), lower)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are among sorted ones, and whether they are."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _told(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one kind: sorted hashes of words or pairs, one of each, their words and counts."""
    rows = table.filter(pc.equal(table.column("kind"), kind))
    words, counts = _values(rows, "rare_c", np.uint64), _values(rows, "counts", np.uint32).astype(np.int64)
    if kind == _PAIRS:
        words = _hash(_values(rows, "rare_b", np.uint64), words)
    order = np.argsort(words)
    return words[order], counts[order]


def _scored(plan: Plan, levels: dict[str, Level], before1: np.ndarray, split_contexts: dict[int, tuple[int, ...]]):
    """(key, surprise, n_grams) of each cell and text. ``before1`` are counts of frequent last words, ``split_contexts`` what follows split words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, table in _cells(batches):
            singles, pairs = _told(table, _SINGLES), _told(table, _PAIRS)
            table = table.filter(pc.is_null(table.column("kind")))
            level = levels.get(lang)
            (a, _), (b, _), (c, last) = (_words(table, plan, k) for k in "abc")
            if not len(a):
                continue
            keys, runs = _values(table, "keys", np.int64), _values(table, "runs", np.uint32).astype(np.int64)
            n = _values(table, "n", np.uint32)
            del table

            at, texts, trigram = _grouped(_hash(a, b, c))
            a, b, c, last = a[at], b[at], c[at], last[at]
            of = _grouped(_hash(a, b)).of
            context3, of3 = np.stack(_context(of, texts)), of
            del a
            # Pairs: those of split words were counted before, where they are not alone.
            at, before, pair = _grouped(_hash(b, c))
            b, c, last = b[at], c[at], last[at]
            if len(pairs[0]):
                spot, hit = _found(pairs[0], _hash(b, c))
                before[hit] = pairs[1][spot[hit]]
            at, _, follows = _grouped(b)
            words = b[at]
            context2 = np.stack(_context(follows, before))
            for x, counts in split_contexts.items():
                context2[:, words == np.uint64(x)] = np.array(counts, float)[:, None]
            # Last words: one pair at least, more where it was counted.
            single = np.append(before1, 0)[np.minimum(last, len(before1))]
            rare = np.flatnonzero(last == _RARE)
            spot, hit = _found(singles[0], c[rare])
            single[rare] = 1
            single[rare[hit]] = singles[1][spot[hit]]
            single = np.maximum(single, 1)

            kinds, lp = sum(level.all1[1:]), np.empty(len(texts))
            for begin in range(0, len(texts), _AT_ONCE):
                now = slice(begin, begin + _AT_ONCE)
                own, two = texts[now], pair[now]
                twice, once = before[two], single[two]
                alone = own == 1  # without it the trigram had no other text and is no longer counted
                gone = alone & (twice == 1)  # then the pair is gone, too
                p = _smoothed(once, level.all1, level.d1, gone, 1 / (kinds - (gone & (once == 1)) + 1))
                p = _smoothed(twice, tuple(context2[:, follows[two]]), level.d2, alone, p)
                lp[now] = np.log(_smoothed(own, tuple(context3[:, of3[now]]), level.d3, np.ones(len(own), bool), p))
            starts = np.cumsum(runs) - runs
            surprise, spoken = np.add.reduceat(lp[trigram] * n, starts), np.add.reduceat(n, starts, dtype=np.int64)
            at, _, row = _grouped(keys)
            yield pa.record_batch({"key": pa.array(keys[at]), "surprise": pa.array(-np.bincount(row, surprise)), "n_grams": pa.array(np.bincount(row, spoken).astype(np.int64))})
    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row of each ``key`` (a hash of text and language) of ``docs`` (key, text, lang); only copies go through a shuffle."""
    repeated = written(docs.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    maybe, surely_not = split_likely(docs, repeated, "key")
    return surely_not.unionAll(written(maybe.dropDuplicates(["key"]), "once").select(docs.columns))


@contextmanager
def _sparing(spark: SparkSession) -> Iterator[None]:
    """Queries run here delete their shuffle files when they end, and send Python few rows at once, since packed rows are large."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    was = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _discounts(counts: list[int]) -> np.ndarray:
    """0 and the three discounts of modified Kneser-Ney (Chen & Goodman, 1999) for counts of one, two and more.

    They come from the counts of counts n1 to n4; where those that a discount needs are not all there, it is half its count.
    """
    n = [0, *counts]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
    return np.array([0.0, *(k / 2 if y is None or not n[k] else min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) for k in (1, 2, 3))])


def _plan(rows: DataFrame, source: Source) -> Plan:
    """Frequent words of a sample of rows, and over how many cells they are split."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for *_, owner, _, (_, c_at, _) in source(batch):
                    found, n = np.unique(c_at(np.arange(len(owner))), return_counts=True)
                    yield pa.record_batch({"word": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    spark = rows.sparkSession
    cells = SCORE_PASSES * max(MIN_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    every = max(1, rows.select("key").count() // _SAMPLE_ROWS)
    counted = rows.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "sample")
    top = counted.orderBy(F.desc("n"), "word").limit(_NUMBERED).toArrow()
    found, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    total = counted.agg(F.sum("n")).first()[0] or 1
    _, at = np.unique(found >> np.uint64(64 - _SLOT_BITS), return_index=True)  # the most frequent one of a slot
    return Plan(cells, found[at], np.maximum(1, np.ceil(n[at] / total * cells / FULL_CELLS)).astype(np.int64))


def _surprise(rows: DataFrame, source: Source, plan: Plan) -> DataFrame:
    """(key, surprise, n_grams) of each key of ``rows`` with a trigram."""
    spark = rows.sparkSession
    sums = lambda k: F.sum(F.col(k)).alias(k)

    def dealt(k: int, passes: int, scoring: bool) -> DataFrame:
        low, high = k * plan.cells // passes, (k + 1) * plan.cells // passes
        return rows.mapInArrow(_packed(source, plan, low, high, scoring), _SCHEMA)

    def gathered(packed: DataFrame) -> DataFrame:
        return packed.repartition("lang", "cell").sortWithinPartitions("lang", "cell")

    tables = [written(gathered(dealt(k, COUNT_PASSES, False)).mapInArrow(_counted(plan), _COUNTED), "counts") for k in range(COUNT_PASSES)]
    counts = reduce(DataFrame.unionAll, tables)
    few = written(counts.filter(F.col("kind").isin(_COUNTS, _FREQUENT, _FOLLOWED)).groupBy("kind", "lang", "cell", "last").agg(sums("n")), "few")
    known = counts.filter(F.col("kind").isin(_SINGLES, _PAIRS))

    frequent = few.filter(F.col("kind") == _FREQUENT).select("lang", "last", "n").toArrow()
    words, before = frequent.column("last").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    before1 = np.zeros(len(plan.words), np.int64)
    order = np.argsort(plan.words)
    before1[order[np.searchsorted(plan.words[order], words)]] = before
    of = np.array(frequent.column("lang").to_pylist(), object)
    seen: dict[tuple[str, int], list[int]] = {}
    for r in few.filter(F.col("kind") == _COUNTS).collect():
        seen.setdefault((r["lang"], r["cell"]), [0] * 6)[r["last"]] = r["n"]
    levels = {}
    for lang in {x for x, _ in seen}:
        n = before[of == lang]
        total, *first, more = np.add(seen[lang, 1], [n.sum(), *np.bincount(np.minimum(n, 5), minlength=6)[1:5], (n > 2).sum()]).tolist()
        levels[lang] = Level((total, *first[:2], more), _discounts(first), *(_discounts(seen[lang, order][1:5]) for order in (2, 3)))
    split_contexts: dict[int, list[int]] = {}
    for r in few.filter(F.col("kind") == _FOLLOWED).collect():
        split_contexts.setdefault(r["last"] & 0xFFFFFFFFFFFFFFFF, [0] * 4)[r["cell"]] = r["n"]

    scores = []
    for k in range(SCORE_PASSES):
        low, high = k * plan.cells // SCORE_PASSES, (k + 1) * plan.cells // SCORE_PASSES
        packed = dealt(k, SCORE_PASSES, True).select("*", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("counts"))
        told = known.filter((F.col("cell") >= low) & (F.col("cell") < high)).select(
            "lang", "cell", *[F.col(x) if x in ("rare_b", "rare_c") else F.lit(None).cast(t).alias(x) for x, t in _PACKED.items()], "kind", "counts")
        found = gathered(packed.unionAll(told)).mapInArrow(_scored(plan, levels, before1, split_contexts), "key long, surprise double, n_grams long")
        scores.append(written(found.groupBy("key").agg(sums("surprise"), sums("n_grams")), "scores"))
    return reduce(DataFrame.unionAll, scores).groupBy("key").agg(sums("surprise"), sums("n_grams"))


def left_out_probabilities(trigrams: DataFrame) -> DataFrame:
    """(lang, a, b, c, lp): log probability of c after a, b in the model without one text that holds the trigram.

    Every row of ``trigrams`` is one text's. Discounts are those of the whole model. Below the unigrams lies a uniform
    distribution over the known words and one unknown.
    """
    rows = trigrams.select(F.xxhash64("lang", "a", "b", "c").alias("key"), "lang", "a", "b", "c")
    with _sparing(rows.sparkSession):
        scores = written(_surprise(rows, _of_trigrams, _plan(rows, _of_trigrams)), "lp")
    return rows.distinct().join(scores, "key").select("lang", "a", "b", "c", (-F.col("surprise") / F.col("n_grams")).alias("lp"))


def word_surprise(docs: DataFrame) -> DataFrame:
    """(key, surprise, n_grams) of each distinct key of ``docs`` (key, text, lang) with words: negative log probability and number of words with a letter or digit."""
    with _sparing(docs.sparkSession):
        rows = distinct_texts(docs.withColumn("lang", F.coalesce("lang", F.lit(""))))
        return written(_surprise(rows, _of_texts, _plan(rows, _of_texts)), "surprise")
