"""Screen of documents before the passes of a large benchmark: no document with a piece is lost, others are left out."""

import random

from calltrail.llm import decontaminate as D


def test_screen_keeps_every_document_with_a_piece(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(300)] + [(400, ""), (401, "one two")]
    rows = []
    for i in range(400):
        text = [word() for _ in range(rng.randint(0, 80))]
        if i % 4 == 0:
            words = rng.choice(items[:300])[1].split()
            cuts = D._cuts(len(words), D.ERROR_RATE)
            k = rng.randrange(len(cuts) - 1)
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in words[cuts[k]:cuts[k + 1]]]
        rows.append((i, " ".join(text)))
    rows += [(0, rows[0][1]), (None, rows[4][1]), (500, None), (501, ""), (502, " \n ")]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in D.suspects(docs, tests).collect()]
    assert {r for r in rows if r[0] is None or r[0] < 400 and r[0] % 4 == 0} <= set(left) and left.count(rows[0]) == 2
    assert len(left) <= 105 and not {500, 501, 502} & {k for k, _ in left}
    assert D.suspects(docs, tests.limit(0)).count() == 0
    one, several = (sorted(map(str, D.find_leaks(docs, tests, item_bytes=size).collect())) for size in (D.ITEM_BYTES, 500))
    assert one == several


def test_several_passes_read_the_suspects(spark):
    docs = spark.createDataFrame([(i, f"nothing of this kind stands in document {i}") for i in range(50)] + [(99, "a b c d e f g h i j k l m n o p")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j k l m n o x"), (3, "q r s t u v w x")], "item_id long, text string")
    found = D.find_leaks(docs, items, item_bytes=5)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()) == [(99, 1, 0), (99, 2, 1)]
    assert all("suspects-" in f for f in found.inputFiles())
