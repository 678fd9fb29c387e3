"""Rolling hashes and minimizers over many texts at once, in NumPy.

Texts are laid end to end as code points. A gram hash is polynomial modulo 2**64 over mixed code points with
an odd base, so a window's hash is a difference of prefix sums times a power of the base's inverse.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ODD = (_BASE | 1, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Mixed codes of the code points below U+10000, for each of the two hashes.
_CODES = [mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(_BASE * (k + 1) & (2**64 - 1))) for k in range(2)]
_cached: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` or more; kept, as they depend on nothing else."""
    have = _cached.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 17), base & (2**64 - 1), dtype=np.uint64)
        out[0] = 1
        have = _cached[base] = np.multiply.accumulate(out)
    return have[:n]


class Texts:
    """Texts laid end to end: ``chars``, the ``start`` and ``end`` of each, and for each position its text's end."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.end = np.cumsum(self.sizes)
        self.start = self.end - self.sizes
        self.n = len(self.chars)
        self.end_at = np.repeat(self.end, self.sizes)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _prefix(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self._sums:
            base = _ODD[which]
            inverse = pow(base, -1, 2**64)
            code = _CODES[which][np.minimum(self.chars, 0xFFFF)]
            wide = np.flatnonzero(self.chars > 0xFFFF)
            code[wide] = mix(self.chars[wide].astype(np.uint64) + np.uint64(_BASE * (which + 1) & (2**64 - 1)))
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            if self.n:
                np.cumsum(code * _powers(base, self.n), out=sums[1:])
            self._sums[which] = sums, _powers(inverse, self.n + 1)
        return self._sums[which]

    def hashes(self, at: np.ndarray, size, which: int = 0) -> np.ndarray:
        """Hashes of the windows of ``size`` characters that start at ``at``; they must lie in the texts."""
        sums, inverse = self._prefix(which)
        to = at + size
        return mix((sums[to] - sums[at]) * inverse[at] + np.asarray(size, dtype=np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i:i+width] for each i with a full window."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimizers(t: Texts, size: int, span: int) -> np.ndarray:
    """For every position the place of the minimizer of the window of ``span`` characters that starts there, -1 where none does.

    It is the leftmost of the window's grams of ``size`` characters with the least key, so equal windows have it at the same
    place in them, and places never go back from one window to the next.
    """
    out = np.full(t.n, -1, dtype=np.int64)
    if t.n < span:
        return out
    sums, inverse = t._prefix(0)
    mask = np.uint64((1 << int(t.n).bit_length()) - 1)
    keys = (sums[size:] - sums[:-size]) * inverse[: t.n - size + 1]
    keys = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    found = (sliding_min(keys, span - size + 1) & mask).astype(np.int64)
    inside = np.arange(len(found)) + span <= t.end_at[: len(found)]
    out[: len(found)] = np.where(inside, found, -1)
    return out
