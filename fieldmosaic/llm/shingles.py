"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

from .common import lower_ascii, mix, word_hashes, words


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashed shingles in ascending order, and the n + 1 places where rows begin and end.

    A row with fewer words than `width` has one shingle, of all its words; a row without words has none.
    """
    begin, end, row = words(data, at)
    n = len(at) - 1
    h = word_hashes(lower_ascii(data), begin, end)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    short = (count > 0) & (count < width)
    starts = np.flatnonzero((np.arange(len(h)) - first[row]) + width <= count[row]) if len(h) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        value = np.zeros(len(starts), np.uint64)
        for k in range(width):
            value = mix(value + h[starts + k] + np.uint64(k + 1))
        few, owner = [], np.flatnonzero(short)
        for r in owner:
            x = np.uint64(0)
            for k in range(count[r]):
                x = mix(x + h[first[r] + k] + np.uint64(k + 1))
            few.append(x)
    held = np.zeros(n, np.int64)
    held[:] = np.where(short, 1, np.maximum(count - width + 1, 0))
    out, at = np.zeros(int(held.sum()), np.uint64), np.concatenate(([0], np.cumsum(held)))
    long = np.ones(len(out), bool)
    long[at[owner]] = False
    out[long], out[at[owner]] = value, np.array(few, np.uint64)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            out[i:j].sort()
    rows = np.repeat(np.arange(n), held)
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return out[keep], np.searchsorted(rows[keep], np.arange(n + 1))
