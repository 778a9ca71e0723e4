"""Arithmetic in the prime field of 2^61 - 1 elements on numpy arrays of uint64."""

from __future__ import annotations

import numpy as np

P = np.uint64((1 << 61) - 1)
_M31 = np.uint64((1 << 31) - 1)
_M30 = np.uint64((1 << 30) - 1)
_S = {n: np.uint64(n) for n in (1, 30, 31, 61)}


def reduce(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> _S[61])
    return np.where(x >= P, x - P, x)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b without leaving 64 bits: halves of 31 bits, and 2^61 = 1 in this field."""
    ah, al, bh, bl = a >> _S[31], a & _M31, b >> _S[31], b & _M31
    mid = reduce(ah * bl + al * bh)
    low = reduce(al * bl)
    return reduce(reduce((ah * bh) << _S[1]) + (mid >> _S[30]) + ((mid & _M30) << _S[31]) + low)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= P, s - P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + P - b)


def power(a: np.ndarray, n: int) -> np.ndarray:
    out = np.ones_like(a)
    while n:
        if n & 1:
            out = mul(out, a)
        n >>= 1
        if n:
            a = mul(a, a)
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """1/a, and 0 for 0."""
    return power(a, int(P) - 2)


def points(seed: int, n: int) -> np.ndarray:
    """n evaluation points, the same on every machine for the same seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, int(P), n, dtype=np.uint64)


def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve many square systems at once: m is (systems, n, n+1); gives (solutions, regular)."""
    m = m.copy()
    g, n = m.shape[:2]
    rows = np.arange(g)
    regular = np.ones(g, bool)
    for c in range(n):
        pivot = c + np.argmax(m[:, c:, c] != 0, axis=1)
        top = m[rows, pivot].copy()
        m[rows, pivot] = m[:, c]
        regular &= top[:, c] != 0
        top = mul(top, inverse(top[:, c])[:, None])
        m[:, c] = top
        factor = m[:, :, c].copy()
        factor[:, c] = 0
        m = sub(m, mul(factor[:, :, None], top[:, None, :]))
    return m[:, :, n], regular


def evaluate(coeffs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Horner; coeffs (k, terms) from the constant term up, one polynomial for each of the k x."""
    out = coeffs[:, -1].copy()
    for i in range(coeffs.shape[1] - 2, -1, -1):
        out = add(mul(out, x), coeffs[:, i])
    return out
