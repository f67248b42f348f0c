"""Language identification: held-out accuracy, plain versions of its parts, edge rows."""

import os
import re
import zlib
from collections import Counter

os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np  # noqa: E402
import pytest  # noqa: E402

from calltrail.llm import languages  # noqa: E402
from calltrail.llm.languages import codewords, decode, gram_features, identify_languages  # noqa: E402
from calltrail.llm.words import mix  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"xx": "kata moru tike sona", "yy": "brug flem stord gnil", "zz": "aeio ueia oiea iuoa"}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def made(n=240):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(1, 30))), lang))
    return out


def test_held_out_accuracy_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    rows = [(r, got[r["doc_id"]]) for r in docs.collect()]
    assert len(got) == docs.count() and all(g["held_out"] == held(r["doc_id"]) for r, g in rows)
    tested = [(r["lang"], g["lang_pred"]) for r, g in rows if g["held_out"]]
    assert sum(a == b for a, b in tested) >= 0.98 * len(tested)
    assert all(0 <= g["score"] <= 1 for _, g in rows)


def test_labels_of_held_out_rows_and_other_columns_play_no_part(spark):
    rows = made()
    one = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", source string")
    lied = spark.createDataFrame([(i, t, "xx" if held(i) else lang, "t" + lang) for i, t, lang in rows], SCHEMA + ", source string").repartition(5)
    plain = lambda df: sorted(tuple(r) for r in identify_languages(df).collect())
    assert plain(one) == plain(lied)
    assert all(r[2] == lang for r, (_, _, lang) in zip(plain(one), rows))


def test_edge_rows(spark):
    long = "kata moru " * 300_000
    rows = made() + [(1000, None, "xx"), (1001, "", "yy"), (1002, " 12 +-\n", "zz"), (None, "brug flem stord", "yy"), (1003, "aeio ueia", None), (1004, long, None),
                     (5, made()[5][1], "zz"), (1005, "KATA MORU", None)]
    df = spark.createDataFrame([(*r, 1, True, 7) for r in rows], SCHEMA + ", mark int, lettered boolean, held_out int")
    got = {(r["doc_id"], i): r for i, r in enumerate(sorted(identify_languages(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    assert len(got) == len(rows)
    by = {}
    for (i, _), r in got.items():
        by.setdefault(i, []).append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 and by[i][0]["ambiguous"] for i in (1000, 1001, 1002))
    assert by[None][0]["lang_pred"] == "yy" and not by[None][0]["held_out"]
    assert by[1003][0]["lang_pred"] == "zz" and by[1004][0]["lang_pred"] == "xx" and by[1005][0]["lang_pred"] == "xx"
    assert len(by[5]) == 2 and by[5][0] == by[5][1]


def test_few_or_no_languages(spark):
    one = spark.createDataFrame([(i, "some text", "xx") for i in range(8)] + [(9, "12", "xx")], SCHEMA)
    assert Counter(r["lang_pred"] for r in identify_languages(one).collect()) == {"xx": 8, "und": 1}
    none = spark.createDataFrame([(i, "some text", None) for i in range(4)], SCHEMA)
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in identify_languages(none).collect()} == {("und", 0.0, True)}
    assert identify_languages(none.limit(0)).collect() == [] and identify_languages(one.limit(0)).collect() == []


def test_a_copied_text_holds_most_rows(spark):
    rows = made(120) + [(i, "kata moru kata", "xx") for i in range(2000, 4000)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(spark.createDataFrame(rows, SCHEMA), sample_texts=90).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_text_of_two_languages_is_ambiguous():
    code, trust = codewords(3), np.full((3, 3), 1 / 3)
    best, share = decode(np.array([[8.0, 8.0, 8.0], [0.0, 0.0, 0.0]]) * code[1], code, trust)
    assert best[0] == 1 and share[0] > 0.9 and abs(share[1] - 1 / 3) < 1e-9


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codewords_stand_apart(n):
    code = codewords(n).astype(int)
    apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
    assert apart >= max(1, code.shape[1] // 5) and (np.abs(code.sum(0)) < n).all()
    # One wrong place does not change what is decoded where words are at least three apart.
    if apart >= 3:
        for k in range(n):
            margin = 5.0 * code[k]
            margin[0] *= -1
            assert decode(margin[None], code, np.full(code.shape, 1 / code.shape[1]))[0][0] == k


def test_features_by_definition(monkeypatch):
    texts = ["", "ab  c!d", "éa 1 b", "x", "   ", "zz top " * 9]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        plain = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.encode())
        for n in languages.GRAMS:
            for k in range(len(plain) - n + 1):
                value = int.from_bytes(plain[k:k + n], "little") + (n << 40)
                want[i, int(mix(np.array([value], np.uint64))[0]) % 64] += 1
        want[i] = np.sqrt(want[i]) / max(np.sqrt(want[i].sum()), 1e-9)
    for piece in (1 << 20, 5):
        monkeypatch.setattr(languages, "_PIECE", piece)
        assert np.allclose(gram_features(data, offsets, 64), want, atol=1e-6)
