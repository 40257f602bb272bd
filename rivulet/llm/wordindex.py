"""Words of byte blocks as arrays: vectorised tokenising and hashing."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_table() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: digits, a-z, all of a multi-byte character."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


class WordHasher:
    """64-bit polynomial hashes of words: prefix sums times inverse powers, exact modulo 2^64."""

    def __init__(self) -> None:
        self.mix = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, _ODD, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps)
            steps[1:] = pow(_ODD, -1, 1 << 64)
            self.inverse = np.cumprod(steps)

    def words(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int = 1 << 22):
        """``starts, ends, rows, hashes`` of the words of a block whose rows begin at ``offsets``.

        Works on ``most`` bytes at a time, cut where no word is, so that a very long text needs no more memory than that.
        """
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # No word goes on over the end of a row.
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        rows = np.searchsorted(offsets, starts, "right") - 1
        hashes, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
            x, y = starts[at], ends[upto - 1]
            self._grow(y - x + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.mix[data[x:y]] * self.power[: y - x])])
            s, e = starts[at:upto] - x, ends[at:upto] - x
            hashes[at:upto] = (sums[e] - sums[s]) * self.inverse[s]
            at = upto
        return starts, ends, rows, hashes
