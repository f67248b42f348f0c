"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_KNOWN = " \n\tabcdefghijklmnopqrstuvwxyz0123456789@.+-()_%:/,;=\"'#"
_LETTER, _OTHER = len(_KNOWN), len(_KNOWN) + 1
N_SYMBOLS = len(_KNOWN) + 2
_ASCII = np.full(128, _OTHER, np.int64)
for _i, _c in enumerate(_KNOWN):
    _ASCII[ord(_c)] = _i
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ASCII[ord(_c)] = _KNOWN.index(_c.lower())

Params = dict[str, np.ndarray]


def symbols(text: str) -> np.ndarray:
    """Symbol of each character: case is folded, letters beyond ASCII are one symbol."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], _LETTER)


def new_params(n_tags: int, hidden: int = 16, embed: int = 12, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
    p = {"embed": draw(N_SYMBOLS, embed), "out": draw(2 * hidden, n_tags), "out_b": np.zeros(n_tags, np.float32), "moves": draw(n_tags, n_tags) * 0.1, "begin": np.zeros(n_tags, np.float32)}
    for side in "fb":
        p |= {f"x{side}": draw(embed, 4 * hidden), f"h{side}": draw(hidden, 4 * hidden), f"b{side}": np.zeros(4 * hidden, np.float32)}
        p[f"b{side}"][hidden:2 * hidden] = 1.0  # open forget gates
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x: np.ndarray, p: Params, side: str, keep: bool):
    """Hidden states (time x rows x hidden) in time order; for training also the gates and cells."""
    steps, rows, _ = x.shape
    hidden = p[f"h{side}"].shape[0]
    given = x @ p[f"x{side}"] + p[f"b{side}"]
    h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    out = np.empty((steps, rows, hidden), np.float32)
    saved = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ p[f"h{side}"]
        gates = _sigmoid(z[:, :3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(z[:, 3 * hidden:])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((t, i, f, o, g, before, tc, h_before))
    return out, saved


def _lstm_back(x: np.ndarray, d_out: np.ndarray, saved, p: Params, side: str, grads: Params) -> np.ndarray:
    hidden = p[f"h{side}"].shape[0]
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    dz_all = np.empty((*d_out.shape[:2], 4 * hidden), np.float32)
    grads[f"h{side}"] = np.zeros_like(p[f"h{side}"])
    for t, i, f, o, g, before, tc, h_before in reversed(saved):
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        grads[f"h{side}"] += h_before.T @ dz
        dh, dc = dz @ p[f"h{side}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * hidden)
    grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
    grads[f"b{side}"] = flat.sum(0)
    return dz_all @ p[f"x{side}"].T


def emissions(ids: np.ndarray, p: Params, keep: bool = False):
    """Scores of tags (time x rows x tags) for symbols (rows x time)."""
    x = p["embed"][ids.T]
    forward, saved_f = _lstm(x, p, "f", keep)
    backward, saved_b = _lstm(x, p, "b", keep)
    both = np.concatenate([forward, backward], 2)
    scores = both @ p["out"] + p["out_b"]
    return (scores, x, both, saved_f, saved_b) if keep else scores


def _crf_grads(scores: np.ndarray, tags: np.ndarray, p: Params) -> tuple[float, np.ndarray, Params]:
    """Negative log likelihood a row, its gradient by scores, and by moves and begin. Forward and backward sums are scaled."""
    steps, rows, n = scores.shape
    top = scores.max(2, keepdims=True)
    weight, moves = np.exp(scores - top), np.exp(p["moves"])
    alpha, beta, scale = np.empty_like(weight), np.empty_like(weight), np.empty((steps, rows, 1), weight.dtype)
    for t in range(steps):
        now = weight[t] * (alpha[t - 1] @ moves if t else np.exp(p["begin"]))
        scale[t] = now.sum(1, keepdims=True)
        alpha[t] = now / scale[t]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = ((weight[t + 1] * beta[t + 1]) @ moves.T) / scale[t + 1]
    total = (np.log(scale) + top).sum((0, 2))
    d = alpha * beta
    d_begin = d[0].sum(0)
    after = (weight[1:] * beta[1:] / scale[1:]).reshape(-1, n)
    d_moves = moves * (alpha[:-1].reshape(-1, n).T @ after)
    at = np.arange(rows)
    gold = p["begin"][tags[:, 0]].copy()
    d_begin -= np.bincount(tags[:, 0], minlength=n)
    for t in range(steps):
        gold += scores[t, at, tags[:, t]]
        d[t, at, tags[:, t]] -= 1
        if t:
            gold += p["moves"][tags[:, t - 1], tags[:, t]]
            np.subtract.at(d_moves, (tags[:, t - 1], tags[:, t]), 1)
    return float((total - gold).mean()), d / rows, {"moves": d_moves / rows, "begin": d_begin / rows}


def train(ids: np.ndarray, tags: np.ndarray, n_tags: int, epochs: int = 8, batch: int = 32, rate: float = 0.02, hidden: int = 16, seed: int = 7) -> Params:
    """Fit by Adam on labelled windows: symbols and tags, rows x time."""
    p = new_params(n_tags, hidden, seed=seed)
    rng = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for a in range(0, len(order), batch):
            some = order[a:a + batch]
            scores, x, both, saved_f, saved_b = emissions(ids[some], p, keep=True)
            _, d, grads = _crf_grads(scores, tags[some], p)
            flat = d.reshape(-1, n_tags)
            grads["out"] = both.reshape(-1, both.shape[2]).T @ flat
            grads["out_b"] = flat.sum(0)
            d_both = d @ p["out"].T
            half = d_both.shape[2] // 2
            dx = _lstm_back(x, d_both[:, :, :half], saved_f, p, "f", grads) + _lstm_back(x, d_both[:, :, half:], saved_b, p, "b", grads)
            grads["embed"] = np.zeros_like(p["embed"])
            np.add.at(grads["embed"], ids[some].T, dx)
            step += 1
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))) / 5)
            for k, g in grads.items():
                g = g / norm
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def joined_path(blocks: Iterable[np.ndarray], p: Params) -> np.ndarray:
    """The likeliest tags of one sequence whose scores (time x tags) come in blocks; a byte for each time and tag is kept of them."""
    back, now = [], None
    for scores in blocks:
        here = np.zeros(scores.shape, np.int8)
        for t in range(len(scores)):
            if now is None:
                now = scores[t].astype(np.float64) + p["begin"]
                continue
            ways = now[:, None] + p["moves"]
            here[t] = ways.argmax(0)
            now = ways.max(0) + scores[t]
        if len(scores):
            now -= now.max()  # sums of long sequences stay small
        back.append(here)
    tags = np.zeros(sum(map(len, back)), np.int8)
    at = len(tags) - 1
    if at >= 0:
        tags[at] = now.argmax()
    for here in reversed(back):
        for t in range(len(here) - 1, -1, -1):
            if at:
                tags[at - 1] = here[t, tags[at]]
            at -= 1
    return tags


def best_path(scores: np.ndarray, p: Params) -> np.ndarray:
    """The likeliest tags of one sequence of scores (time x tags)."""
    return joined_path([scores], p)
