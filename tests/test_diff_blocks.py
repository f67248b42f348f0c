"""Edits of a batch of texts leave in blocks."""

from calltrail.functions.text import diff_blocks, diff_lines


def test_edits_leave_in_blocks():
    pairs = [(f"a{k}\nb\nc", f"a\nb{k}\nc") for k in range(50)] + [(None, "x"), ("y" * 500, "y")]
    blocks = list(diff_blocks(iter(pairs), 100))
    assert [edits for block in blocks for edits in block] == [diff_lines(*p) for p in pairs]
    assert len(blocks) > 5 and max(map(len, blocks)) <= 12
