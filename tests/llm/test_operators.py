"""The ten operators against brute force on small tables, with their edge cases."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

os.environ.setdefault("OMP_NUM_THREADS", "1")  # training is many small products: one thread each

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from calltrail.llm import debruijn, decontaminate, licenses, lines, minhash, packing, pii, quality, queries, rollups, secrets, tagger  # noqa: E402
from calltrail.llm.shared import components, likely_in, without, written  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, folder):
    """The driver's documents with edge cases, and columns whose names clash with inner ones."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = spark.createDataFrame(brute.edge_rows(), SCHEMA)
    return written(rows.unionAll(extra).withColumns({"value": F.lit(1), "row_key": F.lit("r"), "bucket": F.lit(None).cast("string"), "component": F.lit(2), "host": F.lit("h")}), "docs")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df):
    return Counter(map(tuple, df.collect()))


# --- shared ---------------------------------------------------------------------------------------------------------

def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(400)}


def test_filter_table_loses_nothing(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k").unionAll(spark.createDataFrame([(None,)], "k long"))
    keys = written(spark.range(0, 5000, 7).withColumnRenamed("id", "k"), "keys")
    for bits in (1 << 15, 1 << 25):
        assert {r["k"] for r in likely_in(df, keys, "k", bits).collect()} >= set(range(0, 5000, 7))
        assert {r["k"] for r in without(df, keys, "k", bits).collect()} == {None} | {k for k in range(5000) if k % 7}
    assert without(df, keys.limit(0), "k").count() == 5001


# --- 1 --------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@-+ ()%4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 50000 + "." + "a" * 50000 + "@") == []


def test_stretches_hold_every_window_with_a_digit():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("a" * 60 + "1@") for _ in range(rng.randint(0, 900)))
        covered = {i for a, b in pii.stretches(text) for i in range(a, b)}
        for start in range(0, len(text), pii.STEP):
            window = text[start:start + pii.WIDTH]
            if re.search("[0-9@]", window):
                assert covered >= set(range(start, start + len(window)))


def test_crf_gradient():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in tagger.new_params(5, 3, 3).items()}
    scores, tags = rng.standard_normal((7, 2, 5)), rng.integers(0, 5, (2, 7))
    loss, d, grads = tagger._crf_grads(scores, tags, p)
    more = scores.copy()
    more[3, 1, 2] += 1e-6
    assert abs((tagger._crf_grads(more, tags, p)[0] - loss) / 1e-6 - d[3, 1, 2]) < 1e-4
    q = p | {"moves": p["moves"].copy()}
    q["moves"][1, 2] += 1e-6
    assert abs((tagger._crf_grads(scores, tags, q)[0] - loss) / 1e-6 - grads["moves"][1, 2]) < 1e-4


@pytest.fixture(scope="module")
def tagger_params(spark):
    return pii.fit_tagger(spark.createDataFrame([], "row_key long, base array<struct<kind: int, s: bigint, e: bigint>>, stretches array<struct<s: bigint, text: string>>"))


def test_tagger_on_held_out_windows(tagger_params):
    ids, tags = pii.training_windows([], seed=99, made_up=400)
    scores = tagger.emissions(ids, tagger_params)
    hit = wrong = missed = 0
    for r in range(len(ids)):
        got, want = set(pii._spans_of(tagger.best_path(scores[:, r], tagger_params))), set(pii._spans_of(tags[r]))
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert 2 * hit / (2 * hit + wrong + missed) > 0.9


def test_windows_are_reconciled(tagger_params):
    """A span at any place of a long stretch, across window edges too, is found once and whole."""
    for shift in range(0, pii.STEP, 7):
        text = "x" * 3 + " word" * 20 + " " * 1 + "y" * shift + " (555) 019-2834 and more words here" + " 7" * 60
        spans = [(a, b) for k, a, b in pii.tag_stretches([text], tagger_params)[0] if k == 3 and pii.plausible(k, text[a:b])]
        assert [text[a:b] for a, b in spans] == ["(555) 019-2834"]


def test_pii_contract(docs, texts, empty, spark):
    planted = spark.createDataFrame([(5001, "please call (415) 555-2671 before noon", "en", "s"), (5002, "card 4111 1111 1111 1111 12/26 was used", "en", "s"), (5003, "no data here", "en", "s")], SCHEMA)
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs.select(*planted.columns).unionAll(planted))).collect()}
    for k, text in texts.items():
        spans = plain_spans(text or "")
        shown = ",".join(f"{pii.KINDS[a]}:{b}:{c}" for a, b, c in spans)
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert got[k]["base_sha256"] == pii_hash(shown)
        assert set(filter(None, shown.split(","))) <= set(got[k]["spans"].split(","))
    assert sum(got[k]["n_added"] for k in texts) <= 3
    assert {k: got[k]["spans"] for k in (5001, 5002, 5003)} == {5001: "phone:12:26", 5002: "card:5:24", 5003: ""}
    assert pii.find_pii(empty).count() == 0


def pii_hash(text):
    import hashlib
    return hashlib.sha256(text.encode()).hexdigest()


# --- 2 --------------------------------------------------------------------------------------------------------------

def test_lines_by_brute_force(spark, empty):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["menu ", " menu", "foot", "", f"own {i} {k}", f"rare {k}"]) for k in range(rng.randint(0, 9))), None, rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(300, None, None, "a"), (301, "menu\nonly", None, "tiny")]
    totals, on = Counter(r[3] for r in rows), defaultdict(set)
    for k, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if line.strip():
                on[r[3], line.strip()].add(k)
    bad = {key for key, pages in on.items() if len(pages) >= 3 and len(pages) > 0.1 * totals[key[0]]}
    want = Counter((r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in bad),
                    sum(bool(x.strip()) for x in (r[1] or "").split("\n")), sum((r[3], x.strip()) in bad for x in (r[1] or "").split("\n"))) for r in rows)
    got = lines.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), "source", "text")
    assert counted(got.select("doc_id", "text", "_n_lines", "_n_dropped")) == want
    assert lines.drop_boilerplate(empty, "source", "text").count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------

def test_near_duplicates_contract(docs, texts, empty):
    sets = {k: brute.shingles(t) for k, t in texts.items()}
    want = brute.component_map(sets)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_hot_bucket(spark):
    """A group around the threshold, in blocks much smaller than its buckets: no link is lost."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "en", "s"))
    want = brute.component_map({r[0]: brute.shingles(r[1]) for r in rows})
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), block_rows=16).collect()}
    assert got == want


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(8)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    made = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((made[0] == made[1]).mean() - 2000 / 3000) < 0.07


# --- 4 --------------------------------------------------------------------------------------------------------------

def plain_packing(pieces, capacity):
    bins = []
    for size, source, cluster in pieces:
        fit = [b for b in bins if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            best = min(fit, key=lambda b: b["left"])
        else:
            best = {"left": capacity, "s": set(), "c": set()}
            bins.append(best)
        best["left"] -= size
        best["s"].add(source)
        best["c"].add(cluster)
    return sorted(b["left"] for b in bins)


def test_packing_is_best_fit(spark, empty):
    rng = random.Random(9)
    for trial in range(3):
        pieces = sorted(((rng.randint(1, 60), rng.choice([None, *range(70)]), rng.choice([None, *range(90)])) for _ in range(300)), key=lambda x: -x[0])
        code = lambda x: -1 if x is None else x
        got = packing.pack_pieces(np.array([p[0] for p in pieces]), np.array([code(p[1]) for p in pieces]), np.array([code(p[2]) for p in pieces]), 100)
        left = Counter()
        for p, b in zip(pieces, got):
            left[int(b)] += p[0]
        # With ties between residuals the choice may differ from the plain form; both are best fit, so they stay close.
        plain = plain_packing(pieces, 100)
        assert abs(len(left) - len(plain)) <= max(2, len(plain) // 20) and max(left.values()) <= 100


def test_packing_of_documents(spark, docs, empty):
    items = docs.select("doc_id", packing.word_count(F.col("text")).alias("n_tokens"), "source", F.xxhash64("text").alias("cluster"))
    rows = packing.pack(items, capacity=512, shard_rows=64).collect()
    size, sources, clusters, by_doc = Counter(), defaultdict(list), defaultdict(list), Counter()
    for r in rows:
        b = (r["shard"], r["bin"])
        size[b] += r["n_tokens"]
        by_doc[r["doc_id"]] += r["n_tokens"]
        sources[b] += [r["source"]] * (r["source"] is not None)
        clusters[b].append(r["cluster"])
    assert max(size.values()) <= 512
    assert all(len(x) == len(set(x)) for x in (*sources.values(), *clusters.values()))
    want = Counter()
    for r in items.collect():
        want[r["doc_id"]] += r["n_tokens"]
    assert by_doc == +want
    assert packing.pack(empty.select("doc_id", F.lit(1).alias("n_tokens"), "source", F.lit(None).alias("cluster"))).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words, f"end{k}"]), "en", f"s{k}") for k in range(1, 6)] + [(None, " ".join(words), "en", "s6"), (7, "quite another text of a few words", "en", "s7")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_packing(spark, str(tmp_path)).collect()
    assert len(got) == 7 and len({r["bin"] for r in got if r["doc_id"] != 7}) == 6
    assert len({r["cluster"] for r in got}) == 2


# --- 5 --------------------------------------------------------------------------------------------------------------

def test_rollups_by_brute_force(spark, tmp_path, empty):
    store, count = str(tmp_path / "store"), [rollups.word_counter("w1")]
    rng = random.Random(11)
    state = {}
    for batch in range(1, 5):
        rows = [(rng.randrange(30), rng.random() < 0.3, " ".join("x" * rng.randrange(9)), rng.choice(["en", None]), rng.choice(["s1", "s2"]), k) for k in range(25)] + [(None, False, "a b", "en", "s1", 99)]
        changes = spark.createDataFrame(rows, "doc_id long, deleted boolean, text string, lang string, source string, seq int")
        assert rollups.commit_batch(spark, store, batch, changes, count)
        assert not rollups.commit_batch(spark, store, batch, changes, count)
        for doc, deleted, text, lang, source, _ in rows:
            if doc is not None:
                state.pop(doc, None)
                if not deleted:
                    state[doc] = (source, lang, len(text.split()))
        want = defaultdict(lambda: [0, 0])
        for source, lang, n in state.values():
            want[source, lang][0] += 1
            want[source, lang][1] += n
        got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in rollups.totals(spark, store).collect()}
        assert got == dict(want)
    with pytest.raises(ValueError):
        rollups.commit_batch(spark, store, 0, empty.withColumn("deleted", F.lit(False)), count)
    rollups.commit_batch(spark, store, 9, empty.withColumn("deleted", F.lit(False)), count)
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in rollups.totals(spark, store).collect()} == dict(want)


def test_rollups_after_a_half_written_batch(spark, tmp_path):
    """A ledger part without its commit mark does not count and is replaced."""
    store, count = str(tmp_path / "store"), [rollups.word_counter("w1")]
    one = spark.createDataFrame([(1, False, "a b c", "en", "s")], "doc_id long, deleted boolean, text string, lang string, source string")
    rollups.commit_batch(spark, store, 1, one, count)
    spark.read.parquet(f"{store}/ledger/batch=1").write.parquet(f"{store}/ledger/batch=2")
    assert rollups.totals(spark, store).first()["n_tokens"] == 3
    assert rollups.commit_batch(spark, store, 2, one.withColumn("text", F.lit("a b c d")), count)
    assert rollups.totals(spark, store).first()["n_tokens"] == 4


def test_long_texts_are_cut_where_tokens_part():
    rng = random.Random(12)
    text = "".join(rng.choice(["a", "B", "1", " ", "  ", "\n", "é", "!", "'s"]) for _ in range(4000))
    parts = list(rollups.pieces(text, 100))
    import regex
    whole = regex.findall(rollups.PATTERN, text)
    assert "".join(parts) == text and len(parts) > 10
    assert [p for part in parts for p in regex.findall(rollups.PATTERN, part)] == whole


# --- 6 --------------------------------------------------------------------------------------------------------------

def test_repeats_contract(docs, texts, empty):
    want = brute.without_repeats(texts)
    rows = debruijn.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0
    assert debruijn.remove_repeats(empty).count() == 0


def test_branching_paths(spark):
    """Short alphabets make branches, repeats inside a document and shifted overlaps."""
    rng = random.Random(13)
    texts = {}
    pool = [[rng.choice("abc") for _ in range(40)] for _ in range(4)]
    for i in range(80):
        w = []
        while len(w) < rng.randint(5, 90):
            p = rng.choice(pool)
            a = rng.randrange(30)
            w += p[a:a + rng.randint(5, 25)] if rng.random() < 0.8 else [rng.choice("abcdefgh")]
        texts[i] = " ".join(w)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.remove_repeats(spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], SCHEMA)).collect()}
    assert got == brute.without_repeats(texts)


def test_spans_point_to_their_source(docs):
    found = debruijn.repeats(debruijn._prepared(docs.filter("doc_id < 1000"))[2])
    texts = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    spans = debruijn.repeated_spans(found).collect()
    assert spans
    for s in spans:
        assert s["n_words"] >= 13
        assert texts[s["doc_id"]][s["from_word"]:s["from_word"] + s["n_words"]] == texts[s["source_doc"]][s["source_from"]:s["source_from"] + s["n_words"]]


def test_sorted_numbers_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        values = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (debruijn._unpack_sorted(debruijn._pack_sorted(values)) == values).all()


# --- 7 --------------------------------------------------------------------------------------------------------------

def test_longest_rise():
    rng = random.Random(14)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randint(0, 12))]
        best = [1] * len(v)
        for i in range(len(v)):
            for j in range(i):
                if v[j] < v[i]:
                    best[i] = max(best[i], best[j] + 1)
        got = [v[i] for i in licenses.longest_rise(v)]
        assert len(got) == max(best, default=0) and all(a < b for a, b in zip(got, got[1:]))


def test_licenses_in_documents(docs, texts, spark, empty):
    got = Counter((r["doc_id"], r["license"], r["start"], r["end"]) for r in licenses.find_licenses(docs.dropDuplicates(["doc_id"])).collect())
    want = Counter()
    for k, t in texts.items():
        for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
            want.update((k, name, m.start(), m.end()) for m in re.finditer(re.escape(licenses.TEMPLATES[name].rstrip(".")), t or ""))
    assert got == want and want
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("software", "programme").replace("Software", "Programme")
    rows = spark.createDataFrame([(1, "é " + mit + " and " + edited, "en", "s"), (2, "the license of this work is under version", "en", "s"), (3, mit[:150], "en", "s")], SCHEMA)
    found = sorted((r["doc_id"], r["license"], r["start"], r["n_aligned"]) for r in licenses.find_licenses(rows).collect())
    assert [f[:2] for f in found] == [(1, "MIT"), (1, "MIT")] and found[0][2] == 2 and found[1][3] < found[0][3]
    assert licenses.find_licenses(empty).count() == 0


def test_near_misses_get_no_other_license(spark):
    bsd = licenses.TEMPLATES["BSD-2-Clause"]
    rows = ["Released under the BSD License.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2.",
            "This work is licensed under the GNU Lesser General Public License, version 3.", licenses.TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Affero General"),
            licenses.TEMPLATES["BSD-3-Clause"], bsd, "Released under the MIT License."]
    found = {r["doc_id"]: r["license"] for r in licenses.find_licenses(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], SCHEMA)).collect()}
    assert found == {5: "BSD-3-Clause", 6: "BSD-2-Clause", 7: "MIT-notice"}


# --- 8 --------------------------------------------------------------------------------------------------------------

def plain_model(types, order):
    """Modified Kneser-Ney of one language from {word: count}, straight from its definition: n-gram -> probability by order."""
    tables = [Counter() for _ in range(order + 1)]
    for w, c in types.items():
        t = "\x01" * (order - 1) + w + "\x02"
        for i in range(len(w) + 1):
            tables[order][t[i:i + order]] += c
    for n in range(order - 1, 0, -1):
        for g in tables[n + 1]:
            tables[n][g[1:]] += 1
    probability = {"": 1 / (len(tables[1]) + 1)}
    for n in range(1, order + 1):
        kinds = Counter(tables[n].values())
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0
        d = [0] + [max(0.05, min(k - 0.05, k - (k + 1) * y * kinds[k + 1] / kinds[k])) if kinds[k] and kinds[1] else 0.5 * k for k in (1, 2, 3)]
        total, taken = Counter(), Counter()
        for g, c in tables[n].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3)]
        for g, c in tables[n].items():
            probability[g] = (c - d[min(c, 3)]) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * probability[g[1:]]
    return probability


def test_model_equals_its_definition(spark):
    rng = random.Random(15)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(400))
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "zz zq", "fr", "s")], SCHEMA)
    model = quality.fit_model(docs, 3)
    want = plain_model(Counter(text.split()), 3)
    for n, table in enumerate(model.probabilities, 1):
        rows = table.filter("lang = 'en'").collect()
        assert {r["gram"] for r in rows} == {g for g in want if len(g) == n}
        for r in rows:
            assert abs(np.exp(r["lp"]) - want[r["gram"]]) < 1e-9
    # Arrays in every task and the model as tables give the same figures, for unseen characters too.
    other = spark.createDataFrame([(1, text, "en", "s"), (3, "abca xyz dé", "en", "s"), (4, None, "en", "s"), (5, "ab", "de", "s")], SCHEMA)
    small, large = (sorted(quality.score(other, model, size).collect()) for size in (1 << 20, 0))
    for a, b in zip(small, large):
        assert a["doc_id"] == b["doc_id"] and a["n_grams"] == b["n_grams"] and abs(a["surprise"] - b["surprise"]) < 1e-6
    first = -sum(np.log(want[("\x01\x01" + w + "\x02")[i:i + 3]]) for w in text.split() for i in range(len(w) + 1))
    assert abs(small[0]["surprise"] - first) < 1e-6


def test_quality_contract(docs, texts, empty):
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        want = brute.figures(texts[r["doc_id"]]) if r["n_words"] < 4000 else None
        if want:
            assert tuple(r[k] for k in quality.FIGURES) == want
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["low"] <= r["log_perplexity"] <= r["high"])
    judged = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in judged) > 0.9 * len(judged)
    assert quality.quality(empty).count() == 0


def test_band_rejects_strange_text(spark):
    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)), "en", "s") for i in range(60)]
    rows.append((99, " ".join("".join(rng.choice("qxzjkvwyQXZ0123456789") for _ in range(8)) for _ in range(120)), "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[99] and all(got[i] for i in range(60))


def test_band_parts_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [r for r in quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r["base_failed"]]
    bad, good = ([r["kept"] for r in judged if labels.get(r["doc_id"]) == q] for q in (0, 1))
    assert len(bad) > 20 and sum(bad) < 0.3 * len(bad) and sum(good) > 0.98 * len(good)


def test_band_rejects_shuffled_words(spark):
    rng = random.Random(21)
    after = {i: [rng.randrange(400) for _ in range(2)] for i in range(400)}
    rows = []
    for k in range(120):
        walk = [rng.randrange(400)]
        while len(walk) < 150:
            walk.append(rng.choice(after[walk[-1]]))
        rows.append((k, " ".join(f"word{i}" for i in walk), "en", "s"))
    mixed = rows[7][1].split()
    rng.shuffle(mixed)
    rows += [(500, " ".join(mixed), "en", "s"), (501, rows[3][1], "en", "s"), (502, "| " * 60, "en", "s")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[500]["base_failed"] and not got[500]["kept"]
    assert sum(got[i]["kept"] for i in range(120)) > 110
    assert got[501]["log_perplexity"] == got[3]["log_perplexity"] and got[502]["log_perplexity"] is None


# --- 9 --------------------------------------------------------------------------------------------------------------

def test_myers_equals_dynamic_programming():
    rng = random.Random(17)
    for _ in range(300):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 70))], [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        assert decontaminate.best_match(item, text)[0] == brute.edits(item, text)


def test_leaks_by_brute_force(spark, empty):
    rng = random.Random(18)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(50, None), (51, "too short")]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            passage = rng.choice(items[:12])[1].split()
            for _ in range(rng.randint(0, len(passage) // 3)):
                k = rng.randrange(len(passage))
                passage[k:k + 1] = rng.choice([[], ["odd"], [passage[k], "more"]])
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in passage]
        rows.append((i, "\n ".join(w), "en", "s"))
    rows += [(200, None, "en", "s"), (201, "", "en", "s")]
    want = set()
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        for item, t in items:
            n = len((t or "").split())
            if n >= decontaminate.MIN_WORDS:
                d = brute.edits(t.split(), w)
                if d <= decontaminate.budget(n):
                    want.add((i, item, d))
    documents, tests = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.ITEM_BYTES, 200):  # one pass, several passes
        got = decontaminate.find_leaks(documents, tests, item_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want) > 40
    assert decontaminate.find_leaks(empty, tests).count() == 0
    assert decontaminate.find_leaks(documents, tests.limit(0)).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------

def plain_secrets(text):
    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) + ("?" if False else "") for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    assign = re.compile("(" + key + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_contract(docs, texts, empty):
    rng = random.Random(19)
    for _ in range(3000):
        text = "".join(rng.choice(["token", "Api_Key", "APIKEY", "secret", "passwd", " ", "=", ":", '"', "'", "a1", "AKIA", "0123456789ABCDEF", "deadbeef" * 3, "x", "ſecret"]) for _ in range(rng.randint(0, 9)))
        assert [(s, k, e) for k, s, e, _ in secrets.base_spans(text)] == plain_secrets(text), text
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    for k, text in texts.items():
        spans = plain_secrets(text or "")
        shown = ",".join(f"{secrets.KINDS[a]}:{s}:{e}" for s, a, e in spans)
        assert got[k]["base_sha256"] == pii_hash(shown)
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == tuple(sum(a == x for _, a, _ in spans) for x in range(3))
    assert secrets.find_secrets(empty).count() == 0


def test_ownership_parts_examples_from_live_ones(spark):
    example, live = "abcDEF123ghiJKL456mnoPQR", "zyxWVU987tsrQPO654nmlKJI"
    rows = [(i, f"key {example} here", "en", f"owner{i % 9}") for i in range(30)] + [(100, f"my {live}", "en", "owner1"), (101, f"my {live}", "en", "owner1"), (102, None, None, None)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[100]["spans"] == "token:3:27" and got[100]["n_live"] == 1
    assert got[0]["spans"] == "" and got[0]["n_copied"] == 1 and got[102]["spans"] == ""


def test_credential_of_one_owner_in_many_copies_stays_live(spark):
    own, shared = "zyxWVU987tsrQPO654nmlKJI", "abcDEF123ghiJKL456mnoPQR"
    rows = [(i, f"my {own}", "en", "owner1") for i in range(1000)] + [(2000 + i, f"key {shared} here", "en", f"owner{i}") for i in range(4)]
    found = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    assert all(got[i]["spans"] == "token:3:27" and got[i]["n_live"] == 1 for i in range(1000))
    assert all(got[2000 + i]["n_copied"] == 1 for i in range(4))
    by_repository = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, SCHEMA), "doc_id")).collect()}
    assert by_repository[0]["n_copied"] == 1
