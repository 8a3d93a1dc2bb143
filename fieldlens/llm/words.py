"""Hashes of words and of word shingles for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

from .common import mixed, odd_numbers

#: White space that parts words (fixed values): blank and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER[65:91] += np.uint64(32)
#: Bytes hashed at a time; it bounds the temporary arrays.
BLOCK = 1 << 21


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a word never crosses a row."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _spans(data, offsets)
    per_row = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        s, size = starts[first:last], (ends - starts)[first:last]
        head = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(head, size)
        values = LOWER[data[place + np.repeat(s, size)]] * odd_numbers(11, int(size.max()))[place]
        out[first:last] = mixed(np.add.reduceat(values, head) + size.astype(np.uint64))
        first = last
    return out, per_row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``width`` words.

    A row of fewer words has one hash for its whole sequence, a row without words none.
    """
    hashes, per_row = word_hashes(data, offsets)
    keys = odd_numbers(23, width)
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        runs += hashes[i : i + len(runs)] * keys[i]
    runs = mixed(runs)
    out, at = [], 0
    for n in per_row:
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            short = (hashes[at : at + n] * keys[:n]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
