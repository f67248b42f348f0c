"""The prefix trie of rebuilt conversations against a plain one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from calltrail.llm.prefix_trie import ends_digests, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, family=20, rest=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(t, key=lambda p: p[0])] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % rest
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, who in members.items():
        n = (len(who) - 1) * len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += n
            leaves[p[:d]] += not children[p]
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in who if full[c] == p))).encode()).hexdigest()) for p, who in members.items()), key=str)


def got(df, **options):
    return sorted(map(tuple, prefix_trie(df, **options).collect()), key=str)


def random_rows(seed, n, texts=("", "a b", "c", " d\te\n", "é f g")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["u", "a"]) if rng.random() < 0.3 else "u", rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 6))]


@pytest.fixture(scope="module")
def mixed():
    rows = random_rows(1, 130)
    rows += [(c, t, "u", "same") for c in range(200, 260) for t in range(5)]  # a group of copies
    rows += [(-c, t, "u", f"neg {t}") for c in range(1, 45, 3) for t in range(4)]
    rows += [(301, 0, "u", "short"), (303, 0, "u", "x"), (303, 1, "u", "y")]  # without a base
    rows += [(400, None, None, None), (400, 1, "u", "later"), (None, 0, "u", "nobody"), (405, None, "u", None), (405, 2, None, "z")]
    rows += [(500, 7, "u", "again"), (500, 7, "u", "again"), (500, 9, "a", "again")]
    return rows


def test_against_a_plain_trie(spark, mixed):
    random.Random(2).shuffle(mixed)
    df = spark.createDataFrame([(*r, 1, "x", True) for r in mixed], SCHEMA + ", depth long, part string, single boolean")
    assert got(df.repartition(7)) == plain(mixed)


def test_sketch_without_room_changes_nothing(spark, mixed):
    df = spark.createDataFrame(mixed, SCHEMA)
    assert got(df, most_cells=8) == plain(mixed)


def test_conversation_over_several_tasks(spark):
    rows = [(20, t, "u", f"w{t % 3}") for t in range(3000)] + [(40, t, "u", f"w{t % 3}") for t in range(2000)] + [(41, t, "a", "v") for t in range(900)] + [(c, 0, "u", "w0") for c in range(60, 90)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_long(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_long(rows):
    """As ``plain``, with prefixes told by digests, for long conversations."""
    own = defaultdict(list)
    for c, _, role, text in sorted(rows):
        own[c].append((role, text))
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20
        now, path = b"", [b""]
        for x in own.get(base, [])[:h] + turns[h:]:
            now = hashlib.sha256(now + repr(x).encode()).digest()
            path.append(now)
        paths[c] = path, [0] + [len(x[1].split()) for x in own.get(base, [])[:h] + turns[h:]]
    members, words, above = defaultdict(list), {}, {}
    for c, (path, size) in paths.items():
        for d, node in enumerate(path):
            members[d, node].append(c)
            words[d, node] = size[d]
            above[d, node] = (d - 1, path[d - 1]) if d else None
    kids = Counter(above[p] for p in members if above[p])
    saved = {p: (len(who) - 1) * words[p] for p, who in members.items()}
    leaves = {p: int(not kids[p]) for p in members}
    for p in sorted(members, reverse=True):
        if above[p]:
            saved[above[p]] += saved[p]
            leaves[above[p]] += leaves[p]
    return sorted(((min(who), p[0], min(members[above[p]]) if above[p] else None, len(who), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(who) if len(paths[c][0]) - 1 == p[0]).encode()).hexdigest()) for p, who in members.items()), key=str)


def test_one_conversation_and_none(spark):
    df = spark.createDataFrame([(7, 0, "u", "hello there")], SCHEMA)
    assert got(df) == plain([(7, 0, "u", "hello there")])
    assert got(df.limit(0)) == [] and got(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []


def test_turns_of_equal_numbers_have_one_order(spark):
    rows = [(c, 1, "u", x) for c in (0, 20) for x in ("a", "b", "c")]
    one = got(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert one == got(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert len(one) == 4


def test_very_long_text(spark):
    rows = [(0, 0, "u", "word " * 200_000), (20, 0, "u", "word " * 200_000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_digest_of_many_ends(spark):
    df = spark.range(30_000).selectExpr("id % 2 AS depth", "id % 2 AS d1", "0L AS d2", "id AS conv")
    want = {k: hashlib.sha256(",".join(str(i) for i in range(k, 30_000, 2)).encode()).hexdigest() for k in (0, 1)}
    assert {r["depth"]: r["ends_sha256"] for r in ends_digests(df).collect()} == want
