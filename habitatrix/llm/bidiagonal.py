"""Singular values and right singular vectors of a small square matrix.

Householder reflections make the matrix upper bidiagonal.  The differential quotient-difference
algorithm with shifts (dqds) finds the squared singular values; it never subtracts like quantities
but for the shift, so small values keep their relative accuracy.  A vector comes from the two
factorisations of ``B'B - value``, top down and bottom up, joined ("twisted") where the remaining
pivot is smallest.  Values that lie too close for independent vectors form a cluster, in which every
vector is cleared of the earlier ones.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np

EPS = float(np.finfo(float).eps)

#: Values nearer than this share of themselves are one cluster.
CLUSTER_GAP = 1e-3


def bidiagonalise(r):
    """Diagonal, superdiagonal and ``v`` with ``r = u b v'`` for an upper bidiagonal ``b``."""
    a = np.array(r, dtype="float64")
    n = a.shape[0]
    v = np.eye(n)
    for k in range(n):
        h, beta = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * h, h @ a[k:, k:])
        if k < n - 2:
            h, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ h, beta * h)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, beta * h)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _reflector(x):
    """``h`` and ``beta`` so that ``x - beta * h * (h @ x)`` has zeros after its first entry."""
    h = x.copy()
    largest = np.abs(x).max(initial=0.0)
    if len(x) < 2 or largest == 0 or not np.any(x[1:]):
        return h, 0.0
    h /= largest
    h[0] += math.copysign(float(np.linalg.norm(h)), h[0])
    return h, 2.0 / float(h @ h)


def _sweep(q, e, shift: float):
    """One dqds transform; the new arrays and the smallest pivot, below zero if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:  # both are zero: the rest is a matrix of its own
            new_e[i] = 0.0
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / new_q[i]
            new_e[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
        if not least >= 0.0 and shift > 0.0:
            return new_q, new_e, least
    new_q[n - 1] = d
    return new_q, new_e, least


def _last_shift(q, e) -> float:
    """Smaller eigenvalue of the trailing 2 x 2 block."""
    a, b = q[-2] + e[-1], q[-1]
    return max(0.0, (a + b) / 2 - math.hypot((a - b) / 2, math.sqrt(b * e[-1])))


def dqds(a, b):
    """Squared singular values of the bidiagonal matrix (diagonal ``a``, superdiagonal ``b``), unsorted."""
    out: list[float] = []
    stack = [(np.square(np.asarray(a, dtype="float64")), np.square(np.asarray(b, dtype="float64")), 0.0)]
    while stack:
        q, e, moved = stack.pop()
        if q[-1] > 1.5 * q[0]:  # graded upwards: turn round, so that small values are found first
            q, e = q[::-1].copy(), e[::-1].copy()
        while len(q):
            if len(q) == 1:
                out.append(float(q[0]) + moved)
                break
            small = EPS * EPS * (q[:-1] + q[1:]) + EPS * EPS * moved
            cut = np.flatnonzero(e <= small)
            if len(cut):
                at = int(cut[-1]) + 1
                stack.append((q[:at], e[: at - 1], moved))
                q, e = q[at:], e[at:]
                continue
            if e[-1] <= EPS * EPS * max(q[-1], moved) and q[-1] <= q[-2]:
                out.append(float(q[-1]) + moved)
                q, e = q[:-1], e[:-1]
                continue
            shift = _last_shift(q, e)
            for attempt in range(6):
                new_q, new_e, least = _sweep(q, e, shift)
                if least >= 0.0:
                    break
                lower = shift + least
                shift = lower * (1 - 4 * EPS) if attempt == 0 and lower > 0 else (shift / 4 if attempt < 4 else 0.0)
            q, e, moved = new_q, new_e, moved + shift
    return np.array(out)


class _Twisted:
    """Factorisations of ``B'B - value`` for one unreduced bidiagonal block."""

    def __init__(self, a, b):
        self.a, self.b, self.d = a, b, a * a
        self.low = b / a[:-1]  # B'B = L D L' with this subdiagonal of L
        self.norm = float(np.max(self.d) + np.max(b * b))
        self.tiny = 0.0

    def _guard(self, x: float) -> float:
        return x if abs(x) > self.tiny else math.copysign(self.tiny, x)

    def residual(self, z, value: float) -> float:
        bz = self.a * z
        bz[:-1] += self.b * z[1:]
        out = self.a * bz - value * z
        out[1:] += self.b * bz[:-1]
        return float(np.linalg.norm(out))

    def factor(self, value: float) -> _Factors:
        d, low, n = self.d, self.low, len(self.d)
        self.tiny = EPS * (abs(value) + EPS * self.norm)  # a pivot as small as the rounding of ``value``
        down, top, s = np.zeros(n - 1), np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            top[i] = self._guard(s[i] + d[i])
            down[i] = d[i] * low[i] / top[i]
            s[i + 1] = down[i] * low[i] * s[i] - value
        up, bottom, p = np.zeros(n - 1), np.empty(n), np.empty(n)
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            bottom[i + 1] = self._guard(d[i] * low[i] * low[i] + p[i + 1])
            t = d[i] / bottom[i + 1]
            up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        k = int(np.argmin(np.abs(gamma)))
        pivots = np.concatenate([top[:k], [self._guard(gamma[k])], bottom[k + 1 :]])
        return _Factors(down, up, pivots, gamma[k], k)


@dataclasses.dataclass
class _Factors:
    """``N diag(pivots) N'``: ``N`` has ``down`` below its diagonal before row ``k``, ``up`` above it after."""

    down: np.ndarray
    up: np.ndarray
    pivots: np.ndarray
    gamma: float
    k: int

    def _back(self, z):
        """Solve ``N' z = z`` in place, from the twist outwards."""
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / np.abs(z).max()

    def vector(self):
        """The vector whose residual is one multiple of the twist's unit vector."""
        z = np.zeros(len(self.pivots))
        z[self.k] = 1.0
        z = self._back(z)
        return z / np.linalg.norm(z)

    def solve(self, x):
        """One step of inverse iteration."""
        y = x.copy()
        for i in range(self.k):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 2, self.k - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        y /= self.pivots
        z = self._back(y / np.abs(y).max())
        return z / np.linalg.norm(z)


def _cleared(z, earlier):
    """``z`` without its part in the span of ``earlier``, and the share of its length that is left."""
    left = z - earlier @ (earlier.T @ z)
    size = float(np.linalg.norm(left))
    if size > EPS:
        left = left / size
        left -= earlier @ (earlier.T @ left)
        left /= np.linalg.norm(left)
    return left, size


def _block_vectors(a, b, values):
    """Unit vectors of one unreduced block, in the order of its ``values`` (falling)."""
    n = len(a)
    if n == 1:
        return np.ones((1, 1))
    twisted, out = _Twisted(a, b), np.zeros((n, n))
    rng = np.random.default_rng(n)
    cluster = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_GAP * max(abs(value), EPS * values[0]):
            cluster = j
        found = twisted.factor(value)
        z = found.vector()
        if cluster == j:
            # one step of the Rayleigh quotient, kept away from the neighbours
            step = found.gamma * z[found.k] ** 2
            room = min(abs(value - values[i]) for i in (j - 1, j + 1) if 0 <= i < n)
            if 0 < abs(step) < room / 4:
                z = twisted.factor(value + step).vector()
        earlier = out[:, cluster:j]
        z, size = _cleared(z, earlier)
        # a vector that is not exact, or that the earlier ones of its cluster span, takes inverse iterations
        for _ in range(8):
            if size < 0.1:
                z, _ = _cleared(rng.standard_normal(n), earlier)
            elif twisted.residual(z, value) <= n * EPS * twisted.norm:
                break
            z, size = _cleared(found.solve(z), earlier)
        out[:, j] = z
    return out


def right_singular(r):
    """Squared singular values of a square ``r``, falling, and its right singular vectors as columns."""
    a, b, v = bidiagonalise(r)
    n = len(a)
    largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if largest == 0.0:
        return np.zeros(n), v
    a, b = a / largest, b / largest
    # a zero on the diagonal would divide; moving it by the rounding of the reflections is harmless
    a[np.abs(a) < EPS] = EPS
    b[np.abs(b) <= 4 * EPS * np.sqrt(np.abs(a[:-1] * a[1:]))] = 0.0
    b[np.abs(b) <= EPS * EPS] = 0.0
    ends = [0, *(np.flatnonzero(b == 0.0) + 1).tolist(), n]
    values, z = np.zeros(n), np.zeros((n, n))
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        found = -np.sort(-dqds(a[start:end], b[start : end - 1]))
        values[start:end] = found
        z[start:end, start:end] = _block_vectors(a[start:end], b[start : end - 1], found)
    order = np.argsort(-values, kind="stable")
    return values[order] * largest**2, v @ z[:, order]
