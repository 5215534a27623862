"""Byte n-grams of words, as 64-bit integers in numpy.

A word stands between two spaces; contexts don't reach past the space before
it. The latest byte of a context is its lowest, so the context of d bytes is
that of any greater depth under a mask, and zero bytes fill what lies before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes of context that fit beside a symbol.
DEEPEST = 7
SPACE = 0x20


def positions(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, word) for each byte of each word and its closing space."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    gap = bytes(DEEPEST - 1) + b" "
    text = np.frombuffer(gap + b" ".join(w + b" " + gap[:-1] for w in words) + b" ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # Each word takes its length, a space, the filler and the space before the next.
    starts = DEEPEST + np.concatenate(([0], np.cumsum(lengths[:-1] + DEEPEST)))
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[word]
    context = np.zeros(len(at), np.uint64)
    for j in range(DEEPEST):
        context |= text[at - 1 - j].astype(np.uint64) << np.uint64(8 * j)
    return context, text[at], word


def mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * depth)) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(counts[order], first)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
