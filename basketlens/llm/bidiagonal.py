"""Singular values and right singular vectors of a small square matrix, accurately.

`bidiagonal` reduces a matrix by Householder reflections to an upper bidiagonal one with the
same singular values. `dqds` finds their squares by the shifted differential quotient-
difference algorithm, which works on positive numbers alone and so keeps every digit of
small ones. `twisted` recovers eigenvectors of the bidiagonal's square from its factors
taken from the top and from the bottom, joined where the join is best. Numbers are those
of one matrix of a fixed size (dimensions of a vector), never of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)
# Eigenvalues of one block closer than this (relative) are a cluster, whose vectors are
# made orthogonal explicitly.
CLOSE = 1e-5


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V of matrix = U B V'."""
    work = np.array(matrix, dtype=np.float64)
    n = len(work)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """w and the first entry left when x is reflected by 1 - 2 w w'."""
        size = np.linalg.norm(x)
        if size == 0:
            return x, 0.0
        w = x / size
        first = -1.0 if w[0] > 0 else 1.0
        w[0] -= first
        return w / np.linalg.norm(w), first * size

    a, b = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        w, a[k] = reflector(work[k:, k].copy())
        work[k:, k + 1 :] -= 2 * np.outer(w, w @ work[k:, k + 1 :])
        if k < n - 1:
            w, b[k] = reflector(work[k, k + 1 :].copy())
            work[k + 1 :, k + 1 :] -= 2 * np.outer(work[k + 1 :, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return a, b, v


def _pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One qd step with a shift; None if the shift was above the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    if d < 0:
        return None
    least = d
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            new_e[k], d = 0.0, q[k + 1] - shift
        else:
            ratio = q[k + 1] / new_q[k]
            new_e[k] = e[k] * ratio
            d = d * ratio - shift
        if not d >= 0:
            return None
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling."""
    found = []
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            # Cut where the coupling no longer counts.
            cut = next((k for k in range(len(e)) if e[k] <= EPS * EPS * max(moved + q[k], moved + q[k + 1]) or e[k] < TINY), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 2:
                # The larger root, then the smaller from the product, which loses no digits.
                x, y, z = q[0], e[0], q[1]
                total = x + y + z
                root = np.sqrt(max((x - z) ** 2 + y * (y + 2 * (x + z)), 0.0))
                large = (total + root) / 2
                q, e = [large, x * z / large if large else 0.0], [0.0]
                continue
            if q[-1] + e[-1] > 4 * (q[0] + e[0]):  # small values are found at the end
                q, e = q[::-1], e[::-1]
                # Reversal of the factors: q'_k = q_k + e_k of the transposed form.
                stepped = _pass(*_turned(q, e), 0.0)
            else:
                stepped = _pass(q, e, 0.0)
            q, e, least = stepped
            # `least` bounds the smallest value from above; a cautious part of it is tried,
            # and less if that is too much.
            shift = least * (1 - 2 * EPS) if e[-1] < 0.01 * q[-1] else 0.25 * least
            for _ in range(4):
                if shift <= 0 or moved + shift == moved:
                    break
                tried = _pass(q, e, shift)
                if tried is not None:
                    q, e, _ = tried
                    moved += shift
                    break
                shift *= 0.25
        found += [moved + x for x in q]
    return np.sort(np.array(found))[::-1]


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same bidiagonal read from its end: q and e are given reversed, which is a
    lower bidiagonal; the upper one of equal square has its couplings moved by one."""
    # For B' read backwards the tridiagonal B B' has diagonal q_k + e_k and
    # off-diagonals e_k q_(k+1); refactor it from the top.
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0]
    for k in range(n - 1):
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio
    new_q[n - 1] = d
    return new_q, new_e


def _factors(q: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from the top and from the bottom of L D L' - value, and the twist
    entries that join them at each place; D is q, L has l below its diagonal."""
    n = len(q)
    upper, lower, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        d = s[k] + q[k]
        d = d if abs(d) > TINY else -TINY
        upper[k] = q[k] * l[k] / d
        s[k + 1] = upper[k] * l[k] * s[k] - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        d = q[k] * l[k] ** 2 + p[k + 1]
        d = d if abs(d) > TINY else -TINY
        t = q[k] / d
        lower[k] = l[k] * t
        p[k] = p[k + 1] * t - value
    return upper, lower, s + p + value


def twisted(q: np.ndarray, l: np.ndarray, value: float, skip: int = 0) -> tuple[np.ndarray, float]:
    """The eigenvector of L D L' for a value near an eigenvalue, and a better value;
    `skip` takes the next best place for the twist."""
    for _ in range(2):
        upper, lower, gamma = _factors(q, l, value)
        at = int(np.argsort(np.abs(gamma), kind="stable")[min(skip, len(gamma) - 1)])
        z = np.zeros(len(q))
        z[at] = 1.0
        for k in range(at - 1, -1, -1):
            z[k] = -upper[k] * z[k + 1]
        for k in range(at, len(q) - 1):
            z[k + 1] = -lower[k] * z[k]
        size = float(z @ z)
        step = gamma[at] / size
        if skip or not abs(step) <= 8 * EPS * abs(value):
            better = value + step
            value = better if better > 0 and abs(step) < 1e-6 * abs(value) else value
        if not np.isfinite(size):
            break
    return z / np.sqrt(size), value


def _in_cluster(q: np.ndarray, l: np.ndarray, value: float, near: list[np.ndarray]) -> np.ndarray:
    """A vector for one more of almost equal values, at right angles to those found."""
    lower = np.eye(len(q)) + np.diag(l, -1)
    shifted = lower @ np.diag(q) @ lower.T - value * (1 + 4 * EPS) * np.eye(len(q))
    z = np.random.default_rng(len(near)).standard_normal(len(q))
    for step in range(4):
        for y in near * 2:
            z = z - (y @ z) * y
        z = z / np.linalg.norm(z)
        if step < 3:
            z = np.linalg.lstsq(shifted, z, rcond=None)[0] if np.linalg.cond(shifted) > 1e300 else np.linalg.solve(shifted, z)
    return z


def _block_vectors(a: np.ndarray, b: np.ndarray, least: float) -> tuple[list[float], list[np.ndarray]]:
    """Eigenvalues (falling, those above `least`) and eigenvectors of one unreduced block."""
    values = dqds(a, b)
    if len(a) == 1:
        return ([values[0]], [np.ones(1)]) if values[0] > least else ([], [])
    # A diagonal entry of zero would have no factors; it moves by less than rounding.
    size = np.sqrt(values[0])
    a = np.where(np.abs(a) < EPS * EPS * size, EPS * EPS * size, a)
    q, l = a * a, b / a[:-1]
    out_values, out = [], []
    for value in values[values > least]:
        z, better = twisted(q, l, float(value))
        near = [y for x, y in zip(out_values, out) if abs(x - value) <= CLOSE * abs(x)]
        for skip in range(1, 8):
            if not near and np.all(np.isfinite(z)):
                break
            for _ in range(2):
                for y in near:
                    z = z - (y @ z) * y
            size = np.linalg.norm(z)
            if size > 0.3:
                z = z / size
                break
            z, _ = twisted(q, l, float(value), skip)
        else:
            z = _in_cluster(q, l, float(value), near)
        out_values.append(better if not near else float(value))
        out.append(z)
    return out_values, out


def right_vectors(matrix: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values (at most `most`, each above `least` times
    the largest) of a square matrix and, as columns, the right singular vectors."""
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a, b, v = bidiagonal(matrix / scale)
    largest = float(dqds(a, b)[0])
    # Blocks between couplings that are nothing beside their neighbours.
    cuts = np.flatnonzero(np.abs(b) <= EPS * np.sqrt(largest)) + 1
    edges = [0, *cuts.tolist(), len(a)]
    values, vectors = [], []
    for begin, end in zip(edges, edges[1:]):
        found, parts = _block_vectors(a[begin:end], b[begin : end - 1], least * largest)
        for value, part in zip(found, parts):
            z = np.zeros(len(a))
            z[begin:end] = part
            values.append(value)
            vectors.append(z)
    order = sorted(range(len(values)), key=lambda k: -values[k])[:most]
    if not order:
        return np.zeros(0), np.zeros((len(a), 0))
    columns = v @ np.stack([vectors[k] for k in order], axis=1)
    return np.array([values[k] for k in order]) * scale * scale, columns / np.linalg.norm(columns, axis=0)
