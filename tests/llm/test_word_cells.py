"""Cells of the word model: what a scoring cell has to know comes packed, and a large cell takes little memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from calltrail.llm.quality import _base_figures
from calltrail.llm.word_model import _COUNTED, _PAIRS, _SINGLES, Level, Plan, _counted, _of_texts, _packed, _scored, _values
from calltrail.llm.words import find_words, row_blocks, word_hashes


def texts(vocabulary, rows, words, seed):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(vocabulary)]
    return pa.record_batch({"key": pa.array(range(rows), pa.int64()), "text": pa.array([" ".join(rng.choices(known, k=words)) for _ in range(rows)]), "lang": pa.array(["x"] * rows)})


def gathered(plan, batch, scoring):
    rows = pa.Table.from_batches(_packed(_of_texts, plan, 0, plan.cells, scoring)(iter([batch]))).sort_by([("lang", "ascending"), ("cell", "ascending")])
    return rows.append_column("kind", pa.nulls(len(rows), pa.int32())).append_column("counts", pa.nulls(len(rows), pa.binary()))


def test_counting_packs_what_scoring_cells_have_to_know():
    batch = texts(200, 30, 300, 1)
    (_, _, owner, b, (_, last, _)), = _of_texts(batch)
    c = last(np.arange(len(owner)))
    for plan in (Plan(5, b[:0], np.zeros(0, np.int64)), Plan(5, c[:1], np.array([3]))):
        out = pa.Table.from_batches(_counted(plan)(iter(gathered(plan, batch, False).to_batches())))
        assert out.column_names == [x.split()[0] for x in _COUNTED.split(", ")]
        known = out.filter(pa.compute.is_in(out.column("kind"), pa.array([_SINGLES, _PAIRS], pa.int32())))
        assert 0 < len(known) <= 2 * plan.cells  # not one row a word
        words = known.filter(pa.compute.equal(known.column("kind"), _SINGLES))
        got = set(zip(_values(words, "rare_c", np.uint64).tolist(), _values(words, "counts", np.uint32).tolist()))
        before = {}
        for y, z in zip(b.tolist(), c.tolist()):
            before.setdefault(z, set()).add(y)
        assert got == {(z, len(x)) for z, x in before.items() if len(x) > 1 and z not in plan.words.tolist()}


def test_a_large_cell_takes_few_bytes_a_trigram():
    batch = texts(60_000, 300, 1000, 2)
    plan = Plan(1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows, some = gathered(plan, batch, True).to_batches(), np.array([0.0, 0.5, 1.0, 1.5])
    tracemalloc.start()
    out = list(_scored(plan, {"x": Level((10, 4, 3, 3), some, some, some)}, np.zeros(0, np.int64), {})(iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.num_rows for x in out) == 300
    assert peak < 250 * 300_000, peak / 300_000


def test_base_figures_of_like_lines():
    same = "one line that is longer than sixteen bytes"
    batch = pa.record_batch({"text": pa.array([f"{same}\n{same[:-1]}z\n{same}\n \n \n{same} ", f"{same}\n#é x\n#é x\n", None])})
    (_, data, offsets), = row_blocks(batch, "text")
    words = find_words(data, offsets)
    got = {k: v.tolist() for k, v in _base_figures(words, word_hashes(words)).items()}
    assert got["n_dup_lines"] == [1, 1, 0] and got["n_symbols"] == [0, 2, 0] and got["word_chars"] == [140, 35 + 6, 0]
