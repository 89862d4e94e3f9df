"""Arithmetic in the prime field of 2**61 - 1 on numpy arrays of uint64."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P, _M31, _M30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)


def _reduce(s: np.ndarray) -> np.ndarray:
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduce(a + b)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduce(a + (_P - b))


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ah, al, bh, bl = a >> _31, a & _M31, b >> _31, b & _M31
    mid = ah * bl + al * bh
    return _reduce(((ah * bh) << _1) + (mid >> _30) + ((mid & _M30) << _31) + al * bl)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of many elements from one: products are taken pairwise up to a single one, whose inverse is carried down again. Zero gives zero."""
    flat = a.ravel()
    zero = flat == 0
    levels = [np.where(zero, _1, flat)]
    while len(levels[-1]) > 1:
        v = levels[-1]
        if len(v) & 1:
            v = levels[-1] = np.append(v, _1)
        levels.append(mul(v[::2], v[1::2]))
    if not len(flat):
        return a.copy()
    inv = np.array([pow(int(levels[-1][0]), P - 2, P)], np.uint64)
    for v in reversed(levels[:-1]):
        up, inv = np.empty_like(v), inv[: len(v) // 2]
        up[::2], up[1::2] = mul(inv, v[1::2]), mul(inv, v[::2])
        inv = up
    return np.where(zero, np.uint64(0), inv[: len(flat)]).reshape(a.shape)


def segment_products(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of the rows of ``v`` over the segments that begin at ``starts``, by repeated pairing."""
    lens = np.diff(np.append(starts, len(v)))
    while len(v) > len(starts):
        pos = np.arange(len(v)) - np.repeat(starts, lens)
        even = (pos & 1) == 0
        has_next = even & (pos + 1 < np.repeat(lens, lens))
        w = v[even]
        w[has_next[even]] = mul(v[has_next], v[np.flatnonzero(has_next) + 1])
        v, lens = w, (lens + 1) // 2
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else starts
    return v


def horner(coef: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise value at x of polynomials with coefficients (rows x degrees, lowest first)."""
    out = coef[:, -1].copy()
    for k in range(coef.shape[1] - 2, -1, -1):
        out = add(mul(out, x), coef[:, k])
    return out


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many linear systems (n x m x m, n x m) by elimination; free unknowns are 0. Second: which are consistent."""
    n, m, _ = a.shape
    # equations and unknowns lead, systems come last: each step works on long contiguous rows
    t = np.ascontiguousarray(np.concatenate([a, b[:, :, None]], axis=2).transpose(1, 2, 0))
    used = np.zeros((m, n), bool)
    at = np.full((m, n), -1)
    each = np.arange(n)
    for c in range(m):
        can = ~used & (t[:, c] != 0)
        has, piv = can.any(0), can.argmax(0)
        # columns to the left are done with: solved, or of unknowns that stay 0
        u = t[:, c:]
        row = u[piv, :, each].T
        row = mul(row, inverse(row[0]))
        factor = u[:, 0].copy()
        factor[piv, each] = 0
        factor[:, ~has] = 0
        t[:, c:] = sub(u, mul(factor[:, None], row[None]))
        t[piv[has], c:, each[has]] = row[:, has].T
        used[piv[has], each[has]] = True
        at[c, has] = piv[has]
    x = np.where(at >= 0, t[np.maximum(at, 0), m, each[None]], np.uint64(0))
    return x.T, ~((~used & (t[:, m] != 0)).any(0))
