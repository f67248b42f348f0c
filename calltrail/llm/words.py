"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, a few megabytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that part words.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text handled at once; one longer text is handled alone.
BLOCK_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of some rows. ``first[i]`` is the index of row i's first word, ``first[-1]`` the number of words."""

    data: np.ndarray  # bytes of all rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # of rows in data


def row_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text (or one row): slice, bytes, row offsets. NULL is empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes other than ``parting`` ones, never across rows."""
    word = ~parting[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets), offsets)


def word_hashes(words: Words, long_word: int = LONG_WORD) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words over ``long_word`` bytes are hashed one by one."""
    n = len(words.starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    length = words.ends - words.starts
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[:-8] = words.data
    eights = np.ndarray(shape=(len(words.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = length.astype(np.uint64) * _PRIME
    at = np.flatnonzero(length <= long_word)
    begin, left = words.starts[at], length[at]
    while len(at):
        piece = eights[begin] & _KEEP[np.minimum(left, 8)]
        value = (out[at] ^ piece) * np.uint64(0xD6E8FEB86659FD93)
        out[at] = value ^ (value >> np.uint64(32))
        more = left > 8
        at, begin, left = at[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > long_word):
        digest = hashlib.blake2b(words.data[words.starts[i]:words.ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return mix(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; one fewer than ``size`` values give none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _PRIME
        out += hashes[j:j + n]
    return mix(out)


def inside_rows(first: np.ndarray, size: int) -> np.ndarray:
    """Of the windows over all words, those that lie in one row (a mask for ``window_hashes``)."""
    total = int(first[-1])
    keep = np.ones(max(0, total - size + 1), bool)
    for back in range(1, size):
        cut = first[1:-1] - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    return keep
