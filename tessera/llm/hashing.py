"""Vectorised 64-bit hashes of words, word shingles and byte windows of many texts at once.

Bytes are read eight at a time and mixed one after another, so no two short words share a
hash by the algebra of a sum; words of more than LONG bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longest word that is hashed eight bytes at a time.
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Masks that keep the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """For every place the eight bytes from there on as a number; zeros follow the end."""
    body = np.zeros(len(data) + 8, np.uint8)
    body[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", body, strides=(1,))


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each range [lo, hi) of bytes."""
    at, length = eights(data), hi - lo
    out = mix(length.astype(np.uint64) + np.uint64(1))
    live = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        live = live[length[live] > k]
        if not len(live):
            break
        part = at[lo[live] + k] & _FIRST[np.minimum(length[live] - k, 8)]
        out[live] = mix(out[live] * _STEP + part)
    for i in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(data[lo[i] : hi[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For every place with ``length`` bytes behind it (a multiple of 8) a hash of these bytes."""
    n = len(data) - length + 1
    at = eights(data)
    out = np.zeros(n, np.uint64)
    for k in range(0, length, 8):
        out += at[k : k + n] * np.uint64((int(_STEP) * (2 * k + 1)) % (1 << 64))
        out ^= out >> np.uint64(29)
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the len + 1 bounds of its values; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of values of about ``most`` bytes; a longer value is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


#: Bytes of one text that are split into words at a time.
AT_ONCE = 1 << 20


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all values (A-Z in lower case), and the len + 1 bounds by value."""
    if len(data) > AT_ONCE and len(bounds) == 2:
        return _words_of_long(data)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    lo = np.flatnonzero(solid & (~before | cut[:-1]))
    hi = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return word_hashes(_LOWER[data], lo, hi), np.searchsorted(lo, bounds)


def _words_of_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of one long text, read in pieces that end behind white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + AT_ONCE, len(data))
        while end < len(data):  # on to the next white space
            gap = np.flatnonzero(_SPACE[data[end : end + AT_ONCE]])
            end = end + int(gap[0]) if len(gap) else min(end + AT_ONCE, len(data))
            if len(gap):
                break
        piece = data[at:end]
        solid = np.concatenate(([False], ~_SPACE[piece], [False]))
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        parts.append(word_hashes(_LOWER[piece], edge[::2], edge[1::2]))
        at = end
    out = np.concatenate(parts)
    return out, np.array([0, len(out)])


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each value, and their bounds.

    A value with fewer words has one shingle, all its words; one without words has none.
    """
    hashes, at = words(data, bounds)
    counts = np.diff(at)
    full = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(full)))
    first = np.arange(starts[-1]) - np.repeat(starts[:-1] - at[:-1], full)
    out = np.full(len(first), size, np.uint64)
    length = np.repeat(np.minimum(counts, size), full)
    for k in range(size):
        here = length > k
        step = mix(out * _STEP + hashes[np.minimum(first + k, len(hashes) - 1)] + np.uint64(k)) if len(first) else out
        out = np.where(here, step, out)
    out = np.where(length < size, mix(out + length.astype(np.uint64)), out) if len(first) else out
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][full > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return out[new], kept[starts]
