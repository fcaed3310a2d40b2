"""Orthogonal wavelet filters, computed by spectral factorisation."""

from __future__ import annotations

import functools
import math
import re

import numpy as np

#: fixed values: the low-pass filter of coif1 has a closed form in the square root of seven
_S7 = math.sqrt(7)
COIF1 = [(1 - _S7), (5 + _S7), (14 + 2 * _S7), (14 - 2 * _S7), (1 - _S7), (-3 + _S7)]


def _daubechies(n: int, symmetric: bool) -> np.ndarray:
    """The filter with n vanishing moments: (1 + z)^n times a factor of the half-band remainder; of least phase, or nearest to symmetric."""
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.zeros(0)
    pairs = []
    for r in y:
        # z + 1/z = 2 - 4 y
        z = np.roots([1, -(2 - 4 * r), 1])
        pairs.append(tuple(sorted(z, key=abs)))

    def build(choice: list[complex]) -> np.ndarray:
        h = np.array([1.0 + 0j])
        for _ in range(n):
            h = np.convolve(h, [1, 1])
        for z in choice:
            h = np.convolve(h, [1, -z])
        h = h.real
        return h * math.sqrt(2) / h.sum()

    if not symmetric or n < 4:
        return build([p[0] for p in pairs])
    # conjugates go together; of all choices the phase that is nearest to linear
    groups: list[list[tuple]] = []
    left = list(pairs)
    while left:
        p = left.pop(0)
        mates = [q for q in left if abs(q[0] - np.conj(p[0])) < 1e-6 and abs(p[0].imag) > 1e-9]
        for q in mates[:1]:
            left.remove(q)
        groups.append([p, *mates[:1]])

    def bend(h: np.ndarray) -> float:
        w = np.linspace(0.05, 2.5, 200)
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(h)))) @ h))
        return float(np.std(phase - np.polyval(np.polyfit(w, phase, 1), w)))

    best = min((build([p[bits >> i & 1] for i, g in enumerate(groups) for p in g]) for bits in range(1 << len(groups))), key=bend)
    return best if best[0] ** 2 < best[-1] ** 2 or len(best) < 2 else best[::-1]


@functools.cache
def low_pass(name: str) -> tuple[float, ...]:
    """The decomposition low-pass filter of haar, db1 to db10, sym2 to sym8 or coif1."""
    if name in ("haar", "db1"):
        return (1 / math.sqrt(2),) * 2
    if m := re.fullmatch(r"(db|sym)(\d+)", name):
        n = int(m[2])
        if (m[1] == "db" and 1 <= n <= 10) or (m[1] == "sym" and 2 <= n <= 8):
            return tuple(_daubechies(n, m[1] == "sym")[::-1])
    if name == "coif1":
        return tuple(np.array(COIF1) / (16 * math.sqrt(2)))
    raise ValueError(f"unknown wavelet {name}; known: haar, db1-db10, sym2-sym8, coif1")


def high_pass(name: str) -> tuple[float, ...]:
    """The mirror of the low-pass filter; with haar the detail is (x[2k] - x[2k+1]) / sqrt 2."""
    h = low_pass(name)
    return tuple((-1) ** (i + 1) * x for i, x in enumerate(reversed(h)))


def deepest(n: int, name: str) -> int:
    taps = len(low_pass(name))
    return max(0, int(math.log2(n / (taps - 1)))) if n >= taps - 1 and taps > 1 else 0


def decompose(x: np.ndarray, name: str, level: int) -> list[np.ndarray]:
    """[approximation, deepest detail, ..., first detail] with half-sample symmetric borders."""
    lo, hi = np.array(low_pass(name)), np.array(high_pass(name))
    details, a = [], np.asarray(x, float)
    for _ in range(level):
        taps = len(lo)
        n, pad = len(a), taps - 1
        index = np.arange(-pad, n + pad)
        period = np.mod(index, 2 * n)
        wide = a[np.where(period < n, period, 2 * n - 1 - period)]
        size = (n + taps - 1) // 2
        low, high = np.convolve(wide, lo, "valid")[1::2][:size], np.convolve(wide, hi, "valid")[1::2][:size]
        details.append(high)
        a = low
    return [a, *reversed(details)]
