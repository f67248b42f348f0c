"""Prefix trie of conversations: equal prefixes are one node; a count-min sketch keeps unshared ones out of the shuffle.

A prefix of d turns is told by d and two 64-bit digests, sums of (hash of turn j) * ODD**j modulo 2**64. Such sums may be
taken piecewise, so a conversation of any length spreads over tasks, and the digest of a rebuilt conversation follows
from those of its parts.

Every node is named by its smallest member. A conversation that names a node names all its longer prefixes too, so it
names one run of depths, from ``top`` to its end; and every figure of a node is a sum over its members: a leaf counts
at the conversation that names it, repeated words at each conversation that does not name the node they stand in. So two
groupings by prefix suffice, whatever the depth of the trie.

The sketch has two rows of counters. Where one of a prefix's counters is one, no other conversation has that prefix, and
its node is emitted where the row is. Only other prefixes are grouped, which is exact whatever the sketch says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import word_count
from .shared import written

#: Conversations of a block, of which the first gives turns to the others; and rests by which they are taken.
FAMILY, REST = 20, 4
#: Counters of a row of the sketch: twice the prefixes, between these bounds. One bit each is sent to the tasks.
LEAST_CELLS, MOST_CELLS = 1 << 15, 1 << 27
#: Keys with more than this share of the rows are joined apart; there are at most as many as its inverse.
HOT_SHARE = 1 / 2000
# Digits of conversation ids that are put together at once.
_CHUNK = 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_ODD_INVERSE = np.array([pow(int(x), -1, 1 << 64) for x in _ODD], np.uint64)
_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "d1", "d2"]
_ROWS = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, words long, total long, turns long"


def _powers(exponents: np.ndarray, row: int) -> np.ndarray:
    """ODD**exponent modulo 2**64, exponents of either sign."""
    out = np.ones(len(exponents), np.uint64)
    for base, left in ((_ODD[row], np.maximum(exponents, 0)), (_ODD_INVERSE[row], np.maximum(-exponents, 0))):
        left = left.copy()
        while left.any():
            out = np.where(left & 1, out * base, out)
            base = base * base
            left >>= 1
    return out


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as unsigned numbers, NULL as zero."""
    return [batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in names]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, each with its place, digests and words within the part of its conversation that the task holds."""
    part = TaskContext.get().partitionId()
    last, done = None, np.zeros(4, np.uint64)  # of the conversation at the end: turns, digests, words
    with np.errstate(over="ignore"):
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            h1, h2, words = _longs(batch, "h1", "h2", "words")
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
            before = np.zeros((len(first), 4), np.uint64)
            if conv[0] == last:
                before[0] = done
            place = (np.arange(len(conv)) - first[group]).astype(np.uint64) + before[group, 0] + np.uint64(1)
            columns = []
            for k, x in enumerate((h1 * _powers(place.view(np.int64), 0), h2 * _powers(place.view(np.int64), 1), words)):
                sums = np.cumsum(x)
                columns.append((x, sums - (sums - x)[first][group] + before[group, k + 1]))
            last, done = conv[-1], np.array([place[-1], *(c[1][-1] for c in columns)], np.uint64)
            yield pa.record_batch({"part": pa.array([part] * len(conv), pa.int32()), "conv": pa.array(conv), "place": pa.array(place.view(np.int64)),
                                   **{n: pa.array(v.view(np.int64)) for (a, b), names in zip(columns, (("q1", "a1"), ("q2", "a2"), ("words", "total"))) for n, v in zip(names, (a, b))}})


_NUMBERED = "part int, conv long, place long, q1 long, a1 long, q2 long, a2 long, words long, total long"


def _before_parts(table: pa.Table) -> pa.Table:
    """What the parts of one conversation are preceded by: turns, digests and words (a row a part)."""
    table = table.sort_by("part")
    state, rows = [0, 0, 0, 0], []
    for part, conv, place, a1, a2, total in zip(*(table.column(c).to_pylist() for c in ("part", "conv", "place", "a1", "a2", "total"))):
        rows.append((part, conv, *state))
        scale = [int(_powers(np.array([state[0]]), k)[0]) for k in (0, 1)]
        state = [state[0] + place, *(_signed(state[1 + k] + scale[k] * a) for k, a in enumerate((a1, a2))), state[3] + total]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 5))], names=["part", "conv", "b_place", "b1", "b2", "b_total"])


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places, digests and words of turns within their whole conversations."""
    with np.errstate(over="ignore"):
        for batch in batches:
            place, a1, q1, a2, q2, total, b_place, b1, b2, b_total = _longs(batch, "place", "a1", "q1", "a2", "q2", "total", "b_place", "b1", "b2", "b_total")
            s1, s2 = (_powers(b_place.view(np.int64), k) for k in (0, 1))
            out = {"place": place + b_place, "q1": s1 * q1, "a1": b1 + s1 * a1, "q2": s2 * q2, "a2": b2 + s2 * a2}
            yield pa.record_batch({"conv": batch.column("conv"), **{k: pa.array(v.view(np.int64)) for k, v in out.items()},
                                   "words": batch.column("words"), "total": pa.array((total + b_total).view(np.int64))})


_WHOLE = "conv long, place long, q1 long, a1 long, q2 long, a2 long, words long, total long"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, h1, h2, words) with their place in the conversation and the digests up to it.

    Turns are dealt by ranges of (conv, turn), so a conversation may lie in several tasks; what precedes a part is added to
    its rows afterwards. A range has at most two conversations that it shares with others.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    local = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, _NUMBERED), "numbered")
    edges = local.groupBy("part").agg(F.array(F.min("conv"), F.max("conv")).alias("edge")).select("part", F.explode(F.array_distinct("edge")).alias("conv"))
    parted = edges.groupBy("conv").count().filter("count > 1").select("conv")
    last = F.max_by(F.struct("place", "a1", "a2", "total"), "place").alias("x")
    pieces = local.join(F.broadcast(parted), "conv").groupBy("conv", "part").agg(last).select("conv", "part", "x.*")
    before = pieces.groupBy("conv").applyInArrow(_before_parts, "part int, conv long, b_place long, b1 long, b2 long, b_total long")
    return written(local.join(F.broadcast(written(before, "parts")), ["part", "conv"], "left").mapInArrow(_whole, _WHOLE), "turns")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes that end in a turn, with the first ``own`` turns of its conversation exchanged for ``given`` other ones."""
    with np.errstate(over="ignore"):
        for batch in batches:
            place, words, total, own, given, turns = _longs(batch, "place", "words", "total", "own", "given", "turns")
            shift = given.view(np.int64) - own.view(np.int64)
            out = {"depth": (place.view(np.int64) + shift)}
            for k in (0, 1):
                a, q, o, g = _longs(batch, f"a{k + 1}", f"q{k + 1}", f"o{k + 1}", f"g{k + 1}")
                scale = _powers(shift, k)
                digest = g + scale * (a - o)
                out |= {f"d{k + 1}": digest.view(np.int64), f"p{k + 1}": (digest - scale * q).view(np.int64)}
            o, g = _longs(batch, "o_total", "g_total")
            out |= {"words": words.view(np.int64), "total": (g + total - o).view(np.int64), "turns": turns.view(np.int64)}
            names = [f.split()[0] for f in _ROWS.split(", ")]
            yield pa.record_batch({"conv": batch.column("conv"), **{n: pa.array(out[n]) for n in names[1:]}})


def prefixes(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, family: int, rest: int) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations, and a row for each prefix of each rebuilt conversation (``_ROWS``): p1, p2 are the digests one turn earlier."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"), word_count(text).alias("words"))
    whole = numbered_turns(turns)
    most = rest - 1
    figures = F.struct("a1", "q1", "a2", "q2", "words", "total")
    convs = whole.groupBy("conv").agg(F.max("place").alias("n"), *[F.max(F.when(F.col("place") == k, figures)).alias(f"f{k}") for k in range(1, most + 1)])
    convs = written(convs, "conversations")
    base = F.col("conv") - F.col("conv") % family
    own = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(rest))
    family_rows = convs.filter(base != F.col("conv")).withColumn("base", base).withColumn("own", own).filter("own > 0")
    givers = convs.filter(base == F.col("conv")).select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("most"), *[F.col(f"f{k}").alias(f"g{k}") for k in range(1, most + 1)])
    family_rows = family_rows.join(givers, "base", "left").withColumn("given", F.least("own", F.coalesce("most", F.lit(0))))
    at = lambda kind, c: F.get(F.array(*[F.col(f"{kind}{k}") for k in range(1, most + 1)]), (F.col(c) - 1).cast("int"))
    family_rows = written(family_rows.select("conv", "own", "given", (F.col("given") + F.greatest(F.col("n") - F.col("own"), F.lit(0))).alias("turns"), at("f", "own").alias("o"), at("g", "given").alias("g"),
                                             F.slice(F.array(*[F.col(f"g{k}") for k in range(1, most + 1)]), F.lit(1), F.col("given").cast("int")).alias("firsts")), "families")
    slim = family_rows.select("conv", "own", "given", "turns", *[F.col(f"{s}.{c}").alias(f"{s}{n}") for s in "og" for c, n in (("a1", "1"), ("a2", "2"), ("total", "_total"))])
    joined = whole.join(slim, "conv", "left").filter("own IS NULL OR place > own")
    ends = convs.select("conv", F.col("n"))
    joined = joined.join(ends, "conv").withColumn("turns", F.coalesce("turns", "n"))
    own_rows = joined.mapInArrow(_rebuilt, _ROWS)
    given = family_rows.select("conv", "turns", F.posexplode("firsts").alias("at", "x"), "firsts")
    before = F.get("firsts", F.col("at") - 1)
    zero = F.lit(0).cast("long")
    given_rows = given.select("conv", (F.col("at") + 1).cast("long").alias("depth"), F.col("x.a1").alias("d1"), F.col("x.a2").alias("d2"),
                              F.coalesce(before["a1"], zero).alias("p1"), F.coalesce(before["a2"], zero).alias("p2"),
                              F.col("x.words").alias("words"), F.col("x.total").alias("total"), "turns")
    return convs.select("conv"), written(own_rows.unionAll(given_rows), "prefixes")


def _spots(depth: Column, d1: Column, d2: Column, cells: int) -> list[Column]:
    """Counters of a prefix in the two rows of the sketch, which lie behind each other."""
    return [F.pmod(F.xxhash64(depth, d1, d2), F.lit(cells)), F.pmod(F.xxhash64(d2, depth, d1), F.lit(cells)) + cells]


def repeated_counters(rows: DataFrame, cells: int) -> DataFrame:
    """(bucket, bits): bitmaps of the count-min sketch's counters that are two or more. All others that count at all are one."""
    counted = rows.select(F.explode(F.array(*_spots(F.col("depth"), F.col("d1"), F.col("d2"), cells))).alias("spot")).groupBy("spot").count().filter("count > 1")
    return counted.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))


def screened(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``single`` (the sketch proves that no other conversation has the prefix) and ``parent_single``."""
    maps = F.broadcast(written(repeated_counters(rows, cells), "sketch"))
    here = _spots(F.col("depth"), F.col("d1"), F.col("d2"), cells)
    above = _spots(F.col("depth") - 1, F.col("p1"), F.col("p2"), cells)
    found = rows
    names = []
    for k, spot in enumerate((*here, *above)):
        found = found.withColumn(f"s{k}", spot).join(maps.select(F.col("bucket").alias(f"k{k}"), F.col("bits").alias(f"b{k}")),
                                                     F.bitmap_bucket_number(f"s{k}") == F.col(f"k{k}"), "left")
        at = F.bitmap_bit_position(f"s{k}")
        byte = F.conv(F.hex(F.substring(f"b{k}", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        names.append(F.coalesce(F.shiftrightunsigned(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (at % 8 + 1).cast("int"))) > 0, F.lit(False)))
    return found.select(*rows.columns, (~(names[0] & names[1])).alias("single"), ((F.col("depth") > 1) & ~(names[2] & names[3])).alias("parent_single"))


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversation ids in order, joined by commas: at most _CHUNK of one prefix in a row."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY)))
        ids = batch.column("conv").to_pylist()
        at, rows = 0, []
        while at < len(ids):
            to = at + 1
            while to < len(ids) and to - at < _CHUNK and keys[to] == keys[at]:
                to += 1
            rows.append((*keys[at], ids[at], ",".join(map(str, ids[at:to]))))
            at = to
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string()))], names=[*_KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each prefix's chunks in order; one digest is open at a time, whatever their number."""
    now, digest = None, None
    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if key != now:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 3, pa.string()))], names=[*_KEY, "ends_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([c], t) for c, t in zip((*now, digest.hexdigest()), (*[pa.int64()] * 3, pa.string()))], names=[*_KEY, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) from (depth, d1, d2, conv) of the conversations that end in a prefix; a group of any size is joined in chunks."""
    chunks = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(_id_chunks, "depth long, d1 long, d2 long, first long, ids string")
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "depth long, d1 long, d2 long, ends_sha256 string")


def _join_hot(rows: DataFrame, nodes: DataFrame, weight: str, least: float) -> DataFrame:
    """``rows`` joined with ``nodes`` (one row a prefix) by prefix; nodes of a weight above ``least`` go to the tasks instead of their rows."""
    hot = F.broadcast(nodes.filter(F.col(weight) > least))
    cold = nodes.filter(F.col(weight) <= least)
    return rows.join(hot, _KEY).unionByName(rows.join(hot, _KEY, "left_anti").join(cold, _KEY))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                family: int = FAMILY, rest: int = REST, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % ``family`` (all if it has fewer, none if it
    is absent) and its own turns behind its first h, with h = crc32(decimal c) % ``rest``. Each distinct sequence of first
    turns (role, text) is a node, the empty one is the root; conv_id is its smallest member, saved_tokens the words that
    repeat in its subtree (members less one, times the words of the node's last text), ends_sha256 that of the ids of
    the members that end in it, ascending and joined by commas.

    Cases: rows with a NULL conversation id belong to none; NULL turns come first; turns of equal numbers are ordered by a
    hash of role and text; a repeated row is a turn of its own; NULL role or text is empty; a conversation left
    without turns is a member of the root only; an empty table gives no nodes. % takes the sign of c. Other columns are not looked at.
    ``most_cells`` bounds a row of the sketch; with fewer counters more prefixes are grouped, to the same result.
    """
    convs, rows = prefixes(conversations, id_col, turn_col, role_col, text_col, family, rest)
    size = convs.agg(F.count("*").alias("n"), F.min("conv").alias("root")).first()
    if not size["n"]:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    cells = min(most_cells, max(LEAST_CELLS, 1 << (2 * rows.count()).bit_length()))
    marked = written(screened(rows, cells), "screened")
    shared, single = marked.filter("NOT single"), marked.filter("single")
    before = F.col("total") - F.col("words")  # words above the node, the same for all its members
    nodes = written(shared.groupBy(*_KEY).agg(F.min("conv").alias("name"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("turns")).alias("n_ends"),
                                              F.min(before).alias("before")), "nodes")
    # A conversation's run of named depths: its top, the words above it, and whether the last node is a leaf of its own.
    named = (nodes.select(F.col("name").alias("conv"), "depth", "before", (F.col("n") == F.col("n_ends")).alias("leaf"))
             .unionAll(single.select("conv", "depth", before.alias("before"), F.col("depth") == F.col("turns"))))
    runs = named.groupBy("conv").agg(F.min("depth").alias("top"), F.min_by("before", "depth").alias("above"), F.max("leaf").alias("leaf"))
    whole = marked.groupBy("conv").agg(F.max("total").alias("total"))
    runs = written(convs.join(whole, "conv", "left").join(runs, "conv", "left").select(
        "conv", "top", F.coalesce("above", "total", F.lit(0)).alias("repeated"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")), "runs")
    members = written(shared.join(runs, "conv").select(
        *_KEY, "conv", "top", "leaf", F.greatest(F.col("repeated") - before, F.lit(0)).alias("saved"),
        F.coalesce((F.col("top") <= F.col("depth") + 1) & (F.col("turns") > F.col("depth")), F.lit(False)).cast("long").alias("child"), (F.col("depth") == F.col("turns")).alias("ends")), "members")
    figures = members.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_digests(members.filter("ends").select(*_KEY, "conv"))
    figures = figures.join(ends, _KEY, "left").select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    # Above a run's top stands another conversation's node; its prefix is looked up by the row one turn earlier.
    least = rows.count() * HOT_SHARE
    tops = members.filter(F.col("depth") == F.col("top") - 1).select(*_KEY, "conv")
    above = _join_hot(tops, nodes.select(*_KEY, "name", "n"), "n", least).select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    alone = lambda df: df.select(F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), (F.col("turns") > F.col("depth")).cast("long").alias("n_children"),
                                 F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                                 F.when(F.col("turns") > F.col("depth"), F.lit(_EMPTY)).otherwise(F.sha2(F.col("conv").cast("string"), 256)).alias("ends_sha256"))
    tails = alone(single.filter("parent_single")).withColumn("parent_conv_id", F.col("conv_id"))
    inner = figures.unionByName(alone(single.filter("NOT parent_single"))).join(above, ["conv_id", "depth"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(size["root"])).otherwise(F.coalesce("parent", "conv_id"))).drop("parent")
    bare = convs.join(rows.select("conv").distinct(), "conv", "left_anti").select(*[F.lit(0).cast("long").alias(k) for k in _KEY], "conv")
    digest = ends_digests(bare).first()  # one row at most
    root = runs.agg(F.lit(size["root"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.count("*").alias("n_convs"),
                    F.count_if(F.col("top") == 1).alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("repeated").alias("saved_tokens"),
                    F.lit(digest["ends_sha256"] if digest else _EMPTY).alias("ends_sha256"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return tails.select(columns).unionAll(inner.select(columns)).unionAll(root.select(columns))


TRIE_SQL = f"""
WITH RECURSIVE turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT) AS b FROM turns),
crc AS (
  SELECT c, 0 AS k, 4294967295::UBIGINT AS v, b FROM digits
  UNION ALL
  SELECT c, k + 1, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, b
  FROM (SELECT c, k, b, CASE WHEN k % 8 = 0 THEN xor(v, b[k // 8 + 1]) ELSE v END AS x FROM crc WHERE k < 8 * len(b))),
heads AS MATERIALIZED (SELECT c, c - c % {FAMILY} AS base, xor(v, 4294967295::UBIGINT) % {REST} AS h FROM crc WHERE k = 8 * len(b)),
pieces AS (
  SELECT h.c, 0 AS part, t.i, t.role, t.text FROM heads h JOIN turns t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.i > h.h),
rebuilt AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth, role, text FROM pieces),
chains AS MATERIALIZED (
  SELECT c, 0::BIGINT AS depth, '' AS node, '' AS above, '' AS text FROM heads
  UNION ALL
  SELECT r.c, r.depth, sha256(x.node || ' ' || length(r.role) || ' ' || r.role || r.text), x.node, r.text
  FROM chains x JOIN rebuilt r ON r.c = x.c AND r.depth = x.depth + 1),
lengths AS (SELECT c, max(depth) AS n FROM chains GROUP BY c),
nodes AS MATERIALIZED (
  SELECT depth, node, any_value(above) AS above, min(x.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(x.c::VARCHAR, ',' ORDER BY x.c) FILTER (l.n = x.depth), '')) AS ends_sha256,
    (count(*) - 1) * len(list_filter(string_split_regex(any_value(text), '[ \\t-\\r]+'), lambda w: w <> '')) AS saved
  FROM chains x JOIN lengths l ON l.c = x.c GROUP BY depth, node),
children AS MATERIALIZED (SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
up AS (
  SELECT depth, node, depth AS d, node AS a, above, saved, c.node IS NULL AS leaf FROM nodes LEFT JOIN children c USING (depth, node)
  UNION ALL
  SELECT u.depth, u.node, n.depth, n.node, n.above, u.saved, u.leaf FROM up u JOIN nodes n ON n.depth = u.d - 1 AND n.node = u.above WHERE u.d > 0),
sums AS (SELECT d AS depth, a AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM up GROUP BY d, a)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.above LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
JOIN sums s ON s.depth = n.depth AND s.node = n.node
"""
