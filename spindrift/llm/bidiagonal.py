"""Singular values and right singular vectors of a small triangular matrix by qd transforms.

Householder reflections make the matrix bidiagonal, differential qd transforms with safe shifts find the squares
of its singular values to high relative accuracy, and twisted factorisations give a vector for each.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector v and a number so that x - 2 v (v.x) is that number times the first unit vector."""
    size = float(np.linalg.norm(x))
    v = x.astype(float).copy()
    alpha = -size if v[0] >= 0 else size
    v[0] -= alpha
    norm = float(np.linalg.norm(v))
    return (v / norm if norm > 0 else v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of r = U B V'."""
    m, d = np.array(r, float), r.shape[1]
    right = np.eye(d)
    for k in range(d):
        if k < m.shape[0]:
            v, _ = reflector(m[k:, k])
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < d - 2 and k < m.shape[0]:
            v, _ = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    diagonal, upper = np.zeros(d), np.zeros(max(d - 1, 0))
    n = min(m.shape[0], d)
    diagonal[:n] = np.diag(m)[:n]
    for k in range(min(n, d - 1)):
        upper[k] = m[k, k + 1]
    return diagonal, upper, right


def transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step with a shift, and its d values; None if the shift was too large."""
    n = len(q)
    d = q[0] - shift
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [d]
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] > 0:
            t = q[k + 1] / new_q[k]
            new_e[k] = e[k] * t
            d = d * t - shift
        else:
            d = q[k + 1] - shift
        ds.append(d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, ds


def block_values(q: list[float], e: list[float], base: float = 0.0) -> list[float]:
    """Eigenvalues of B'B plus `base`, for squares q of the diagonal and e of the upper diagonal.

    Each round is a step without a shift, whose d values are the reciprocals of the inverse's diagonal, and a step with
    the shift 1 / sum(1/d): Newton's step for the least eigenvalue, which never goes beyond it.
    """
    out: list[float] = []
    while q:
        n = len(q)
        if n == 1:
            return [*out, q[0] + base]
        limit = EPS * EPS * max(base + q[-1], TINY)
        if e[-1] <= limit or e[-1] <= TINY:
            out.append(q.pop() + base)
            e.pop()
            continue
        split = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * min(base + q[k], base + q[k + 1]) or e[k] <= TINY), None)
        if split is not None:
            out += block_values(q[split + 1 :], e[split + 1 :], base)
            q, e = q[: split + 1], e[:split]
            continue
        q, e, d = transform(q, e, 0.0)
        shift = 0.0 if min(d) <= 0 else (1 - 8 * n * EPS) / sum(1 / x for x in d)
        while shift > EPS * EPS * base and shift > TINY:
            done = transform(q, e, shift)
            if done is not None:
                q, e, _ = done
                base += shift
                break
            shift /= 2
    return out


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper multipliers and the twist elements of B'B - value, for a bidiagonal without zeros."""
    n = len(a)
    big, low = a * a, b / a[:-1] if n > 1 else b
    small = max(EPS * EPS * float(big.max()), TINY)
    s, p, lower, upper = np.zeros(n), np.zeros(n), np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + big[i]
        pivot = pivot if abs(pivot) > small else small
        lower[i] = big[i] * low[i] / pivot
        s[i + 1] = lower[i] * low[i] * s[i] - value
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > small else small
        t = big[i] / pivot
        upper[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    return lower, upper, s + p + value


def from_twist(lower: np.ndarray, upper: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(lower) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, len(upper)):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def block_vectors(a: np.ndarray, b: np.ndarray, values: list[float], near: float) -> np.ndarray:
    """A unit vector for each eigenvalue of a bidiagonal without zeros, as columns.

    Values nearer than `near` to each other may give vectors that lean on each other: such ones are made orthogonal, and if
    nothing is left of one, the next best twist is taken.
    """
    out = np.zeros((len(a), len(values)))
    for j, value in enumerate(values):
        lower, upper, gamma = twisted(a, b, value)
        close = [i for i in range(j) if abs(values[i] - value) <= near]
        best, most = None, -1.0
        for at in np.argsort(np.abs(gamma))[: 1 if not close else len(gamma)]:
            z = from_twist(lower, upper, int(at))
            for _ in range(2):
                z = z - out[:, close] @ (out[:, close].T @ z)
            left = float(np.linalg.norm(z))
            if left > most:
                best, most = z / max(left, TINY), left
            if left > 0.5:
                break
        for _ in range(2):  # what rounding left of the nearest ones
            best = best - out[:, close] @ (out[:, close].T @ best)
            best /= np.linalg.norm(best)
        out[:, j] = best
    return out


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, falling, and its right singular vectors as columns."""
    a, b, right = bidiagonalise(r)
    d = len(a)
    scale = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if scale == 0:
        return np.zeros(d), right
    a, b = a / scale, b / scale
    # a zero on the diagonal is made as small as rounding, so that multipliers are finite
    a = np.where(np.abs(a) > EPS * EPS, a, EPS * EPS)
    cuts = [0, *(k + 1 for k in range(d - 1) if abs(b[k]) <= EPS * EPS), d]
    values, vectors = [], np.zeros((d, d))
    for low, high in zip(cuts, cuts[1:], strict=False):
        x, y = a[low:high], b[low : high - 1]
        found = sorted(block_values((x * x).tolist(), (y * y).tolist()), reverse=True)
        vectors[low:high, len(values) : len(values) + len(found)] = block_vectors(x, y, found, 1e-3 * max(found[0], TINY))
        values += found
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale * scale, (right @ vectors)[:, order]
