"""Hashes of any stretch of a byte array from prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = 20


class StretchHashes:
    """Polynomial hashes modulo 2 ** 64 with a random multiplier per byte value, then mixed."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and its inverse, as far as needed yet

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self._powers[0]) <= n:
            for k, base in enumerate((_BASE, _INVERSE)):
                powers = np.full(n + n // 4 + 1, base, np.uint64)
                powers[0] = 1
                self._powers[k] = np.cumprod(powers)
        values = np.random.default_rng(_SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = self._powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * self._powers[0][:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` bytes from each start; equal strings have equal hashes."""
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def everywhere(self, length: int) -> np.ndarray:
        """Hashes of ``length`` bytes from every position that has as many."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def mixed(value: np.ndarray) -> np.ndarray:
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value
