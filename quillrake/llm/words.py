"""Words of whole texts as arrays of hashes, a batch at a time, and hashes of runs of words.

Words are the runs of bytes other than x20 and x09-x0D. A word's hash is a polynomial of its bytes modulo 2**64, mixed; a run's
hash is a polynomial of its words' hashes, mixed. Both come from running sums, so a run costs the same at any length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Bytes whose words are hashed at once, and bits of the longest tables of powers that a worker keeps: 4 MB for each base.
_STEP, _KEPT = 1 << 16, 18
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


@functools.lru_cache(4)
def _powers_to(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below 2**bits."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.ones(1, _U)
        for k in range(bits):
            p = np.concatenate([p, p * _U(pow(b, 1 << k, 2**64))])
        out.append(p)
    return tuple(out)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers at least; longer tables than most batches need are made anew and not kept."""
    bits = max(_KEPT - 1, int(n).bit_length())
    return (_powers_to if bits <= _KEPT else _powers_to.__wrapped__)(base, bits)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _piece_words(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word; ``fresh`` marks bytes that begin a document."""
    ink = ~_SPACE[data]
    starts = np.flatnonzero(ink & (np.concatenate([[True], ~ink[:-1]]) | fresh))
    ends = np.flatnonzero(ink & np.concatenate([~ink[1:] | fresh[1:], [True]])) + 1
    up, down = _powers(BASES[0], len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * down[starts] ^ ((ends - starts).astype(_U) << _U(48)))


class Words:
    """The words of a batch of texts as hashes, and hashes of runs of them. Runs never cross documents."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if lower:  # A-Z only
            data = _LOWER[data]
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = min(len(data), at + _STEP)
            while end < len(data) and not _SPACE[data[end]]:  # pieces end before a space, so that no word is cut
                stop = np.flatnonzero(_SPACE[data[end : end + 4096]])
                end = min(len(data), end + (int(stop[0]) if len(stop) else 4096))
            fresh = np.zeros(end - at, bool)
            firsts = offsets[:-1][(offsets[:-1] >= at) & (offsets[:-1] < end)]
            fresh[firsts - at] = True
            s, h = _piece_words(data[at:end], fresh)
            starts.append(s + at)
            hashes.append(h)
            at = end
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.doc = np.searchsorted(offsets[1:], starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.totals: dict[int, np.ndarray] = {}

    def _total(self, base: int) -> np.ndarray:
        if base not in self.totals:
            t = np.zeros(len(self.hash) + 1, _U)
            np.cumsum(self.hash * _powers(base, len(self.hash))[0][: len(self.hash)], out=t[1:])
            self.totals[base] = t
        return self.totals[base]

    def runs(self, n: int, base: int = BASES[0]) -> np.ndarray:
        """Hash of the ``n`` words from each word on, whatever documents they are of."""
        t = self._total(base)
        k = max(0, len(self.hash) - n + 1)
        return mixed((t[n:] - t[:k]) * _powers(base, k)[1][:k]) if k else np.zeros(0, _U)

    def whole(self, base: int) -> np.ndarray:
        """Hash of all words of each document."""
        t, end = self._total(base), self.first + self.counts
        return mixed((t[end] - t[self.first]) * _powers(base, len(self.hash) + 1)[1][self.first] + self.counts.astype(_U))
