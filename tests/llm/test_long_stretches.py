"""The tagger on stretches of any length: one path through all windows, whatever the blocks they are scored in."""

import random

import numpy as np
import pytest

from calltrail.llm import pii, tagger


@pytest.fixture(scope="module")
def params():
    made = tagger.new_params(pii.N_TAGS)
    made["moves"] = np.random.default_rng(3).standard_normal(made["moves"].shape).astype(np.float32)
    return made


def digits(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("0123456789 -.@+()ab") for _ in range(n))


@pytest.mark.parametrize("n", [1, 47, 48, 95, 96, 97, 144, 145, 5000])
def test_blocks_give_the_path_of_the_whole(params, n):
    text = digits(n, n)
    whole = pii.tag_stretches([text], params, together=1 << 30)
    for rows in (1, 2, 7):
        assert pii.tag_stretches([text], params, rows=rows, together=0) == whole
    assert whole != [[]] or n < 50


def test_path_in_blocks_is_the_best_path(params):
    scores = np.random.default_rng(1).standard_normal((50, pii.N_TAGS)).astype(np.float32)
    want = tagger.best_path(scores, params).tolist()
    for cut in (0, 1, 20, 49, 50):
        assert tagger.joined_path([scores[:cut], scores[cut:]], params).tolist() == want
    best = max(range(pii.N_TAGS ** 3), key=lambda x: _value(scores[:3], params, [x // pii.N_TAGS ** 2, x // pii.N_TAGS % pii.N_TAGS, x % pii.N_TAGS]))
    assert tagger.best_path(scores[:3], params).tolist() == [best // pii.N_TAGS ** 2, best // pii.N_TAGS % pii.N_TAGS, best % pii.N_TAGS]


def _value(scores, p, tags):
    return p["begin"][tags[0]] + sum(scores[t, k] for t, k in enumerate(tags)) + sum(p["moves"][a, b] for a, b in zip(tags, tags[1:]))


def test_long_stretches_stay_whole():
    text = "7 " * 20_000
    assert pii.stretches(text) == [(0, 40_000)]
    assert pii.tag_stretches(["", "a"], tagger.new_params(pii.N_TAGS), together=0)[0] == []
