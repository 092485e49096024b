"""Simple-8b coding of token ids: 4 bits of selector and 60 bits of payload in each 64-bit word.

A slot whose bits are all ones is an escape: the id is the next of the block's exceptions, stored as 32 bits each.
Ids of more than ``cutoff`` bits are escaped; the cutoff of a block is the one with the fewest bytes.
"""

from __future__ import annotations

import numpy as np

#: (ids in a word, bits of each); the selector is the place in this list plus one.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_ESCAPE = np.uint64(2**64 - 1)
_PART = np.concatenate([[0.0], 1.0 / np.arange(1, 61)])
_COUNT = np.zeros(16, np.int64)
_COUNT[1:15] = [n for n, _ in PACKINGS]
#: (bits, share of escapes above which the 32 bits of each cannot pay).
_CUTOFFS = ((15, 0.16), (12, 0.1))
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64) + 1)[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs below the all-ones slot."""
    if len(ids) and ids.max() < len(_WIDTH):
        return _WIDTH[ids]
    return np.frexp(ids.astype(np.float64) + 1)[1].astype(np.uint8)


def _steps(bits: np.ndarray) -> np.ndarray:
    """For each place the most ids that one word can take from there; ``bits`` ends with 60 zeros of padding."""
    n = len(bits) - 60
    most = {1: bits}
    p = 1
    while p < 32:
        prev = most[p]
        most[2 * p] = np.maximum(prev[: len(prev) - p], prev[p:])
        p *= 2
    steps = np.ones(n, np.uint8)
    for count, width in reversed(PACKINGS[:-1]):
        p = 1 << (count.bit_length() - 1)
        reach = np.maximum(most[p][:n], most[p][count - p : count - p + n])
        steps[reach <= width] = count
    return steps


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, exceptions) of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    widths = _widths(ids)
    best = None
    for cutoff, share in ((64, 1.0), *_CUTOFFS):
        over = widths > cutoff
        escapes = int(np.count_nonzero(over))
        if best is not None and not 0 < escapes <= share * n:
            continue
        bits = np.zeros(n + 60, np.uint8)
        bits[:n] = np.where(over, 1, widths) if escapes else widths
        steps = _steps(bits)
        cost = 8 * float(_PART[steps].sum()) + 4 * escapes
        if best is None or cost < best[0]:
            best = (cost, steps, over, escapes)
    _, steps, over, escapes = best
    jump, at, starts = steps.tolist(), 0, []
    while at < n:
        starts.append(at)
        at += jump[at]
    first = np.asarray(starts, np.int64)
    counts = steps[first]
    values = np.zeros(n + 60, np.uint64)
    values[:n] = ids
    if escapes:
        values[:n][over] = _ESCAPE
    words = np.zeros(len(first), np.uint64)
    for k, (count, width) in enumerate(PACKINGS):
        mine = np.flatnonzero(counts == count)
        if not len(mine):
            continue
        at, word = first[mine], np.full(len(mine), np.uint64((k + 1) << 60))
        ones = np.uint64((1 << width) - 1)
        for slot in range(count):
            word |= np.minimum(values[at + slot], ones) << np.uint64(slot * width)
        words[mine] = word
    return words.astype("<u8"), ids[over].astype("<u4")


def decode_block(words: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, all words of a selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    escaped = np.zeros(len(out), bool)
    for k, (count, width) in enumerate(PACKINGS):
        mine = np.flatnonzero(selectors == k + 1)
        if not len(mine):
            continue
        ones = np.uint64((1 << width) - 1)
        slots = (words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & ones
        where = starts[mine][:, None] + np.arange(count)
        out[where] = slots
        escaped[where] = slots == ones
    out, escaped = out[:n].astype("<u4"), escaped[:n]
    out[escaped] = exceptions
    return out
