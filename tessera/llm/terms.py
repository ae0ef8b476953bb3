"""Terms of many texts at once: maximal runs of allowed bytes, each with one space behind it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of one text that are looked at in one go.
AT_ONCE = 1 << 20


def allowed(*gaps: tuple[int, int]) -> np.ndarray:
    """For each byte whether it is part of a term: all but those in the ranges ``gaps``, ends included."""
    out = np.ones(256, bool)
    for lo, hi in gaps:
        out[lo : hi + 1] = False
    return out


#: Bytes of `[^\x20\x09-\x0D]+`, of letters, and of letters and digits. Bytes from 0x80 on are in all.
WORDS = allowed((0x20, 0x20), (0x09, 0x0D))
LETTERS = allowed((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ALPHANUMERICS = allowed((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def squeeze(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms, one space behind each; the len + 1 starts of terms; the len + 1 bounds of values in terms.

    Terms i to j of the result, joined by spaces, are ``out[starts[i] : starts[j] - 1]``.
    """
    body = np.insert(data, bounds[1:], 0x20)
    inside = solid[body]
    inside[bounds[1:] + np.arange(len(bounds) - 1)] = False
    behind = np.zeros(len(body), bool)
    behind[1:] = inside[:-1]
    behind &= ~inside
    kept = inside | behind
    if lower:
        body = _LOWER[body]
    body[behind] = 0x20
    out, last = body[kept], behind[kept]
    starts = np.concatenate(([0], np.flatnonzero(last) + 1))
    return out, starts, np.searchsorted(np.flatnonzero(behind), bounds + np.arange(len(bounds)))


def pieces(data: np.ndarray, solid: np.ndarray, size: int = AT_ONCE) -> Iterator[np.ndarray]:
    """One text in pieces of about ``size`` bytes, cut where no term is."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            gap = np.flatnonzero(~solid[data[end : end + size]])
            end = end + int(gap[0]) if len(gap) else min(end + size, len(data))
            if len(gap):
                break
        yield data[at:end]
        at = end


def values(out: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """The terms with the space behind each, on the same memory."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out)])
