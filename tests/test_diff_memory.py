"""Line diffs of long texts: memory far below the table of lines by lines, and below one bit set for each distinct line."""

import random
import tracemalloc

from calltrail.functions.text import LcsRows, diff_lines


def changed(lines, rng):
    """Some lines replaced, dropped and added; the expected edits are not unique, the texts are."""
    out = []
    for line in lines:
        r = rng.random()
        if r < 0.02:
            out.append(f"new {rng.random()}")
        if r > 0.02 and r < 0.98 or r < 0.01:
            out.append(line)
    return out


def test_long_texts_of_distinct_and_repeated_lines():
    rng = random.Random(5)
    n = 20_000
    a = ["" if rng.random() < 0.3 else f"line {k}" for k in range(n)]
    b = changed(a, rng)
    tracemalloc.start()
    edits = diff_lines("\n".join(a), "\n".join(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [e["text"] for e in edits if e["type"] != "added"] == a and [e["text"] for e in edits if e["type"] != "removed"] == b
    # A bit set for each distinct line of b would take n * n / 16 bytes = 25 MB, the table n * n / 8 = 50 MB.
    assert peak < 18 << 20


def test_masks_are_few_and_right():
    rng = random.Random(6)
    b = [rng.choice(["x", "y", f"z{k}"]) for k in range(400)]
    rows = LcsRows(b[::2], b)
    assert set(rows.masks) <= {"x", "y"} and rows.masks["x"] == sum(1 << j for j, line in enumerate(b) if line == "x")
    assert all(rows._mask(at) == sum(1 << j for j in at) for at in rows.places.values())
