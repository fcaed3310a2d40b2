"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_ODD = int(_rng.integers(2**61, 2**62)) * 2 + 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as was asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


POWERS = _Powers(_ODD)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class _Words(dict):
    """Hashes of words, each taken when first asked for and kept for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_WORDS = _Words()


def words(text: str | None) -> np.ndarray:
    """A hash for each word: a run without ASCII white space, with A-Z in lower case (what lower and split do on bytes)."""
    found = (text or "").encode().lower().split()
    return np.fromiter(map(_WORDS.__getitem__, found), U, len(found))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles, ascending; of fewer words, the whole sequence as one; of none, nothing."""
    w = words(text)
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, U)
    for i in range(width):
        h = mixed(h * U(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return np.unique(h)
