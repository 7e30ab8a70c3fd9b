"""Eigenpairs of a symmetric matrix inside an interval, by contour integration (FEAST).

A rational filter, the quadrature of the resolvent (z I - A)^-1 along a circle round the interval, is applied to a
block of vectors by one complex shifted solve for each quadrature point. It keeps the eigenvectors inside and damps
the others; Rayleigh-Ritz in the filtered block extracts the pairs, and the filter is applied again to them until the
residuals are at rounding. Sylvester's law of inertia tells how many eigenvalues lie above a shift, by the pivots of an
LDL^T factorisation of the matrix in tridiagonal form; it places the interval and proves that no pair inside was missed.
"""

from __future__ import annotations

import numpy as np

POINTS = 16
GROW_AFTER = 6
MOST_PASSES = 120


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squares beside it) of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if np.any(v[1:]):
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            w = rest @ v
            w -= (v @ w) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = length
    return np.diagonal(a).copy(), np.diagonal(a, 1) ** 2


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """The number of eigenvalues above the shift: positive pivots of the LDL^T factorisation of form - shift I."""
    least = np.finfo(float).tiny
    positive, pivot = 0, 1.0
    for entry, square in zip((form[0] - shift).tolist(), [0.0, *form[1].tolist()]):
        pivot = entry - square / pivot or -least
        positive += pivot > 0
    return positive


def _edge(form: tuple[np.ndarray, np.ndarray], wanted: int, low: float, high: float, width: float) -> tuple[float, float]:
    """A bracket (low, high) of the wanted-th largest eigenvalue: at least `wanted` lie above low, fewer above high."""
    while high - low > width:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if count_above(form, middle) >= wanted:
            low = middle
        else:
            high = middle
    return low, high


def interval_of_largest(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): an interval round the `count` largest eigenvalues, `wanted` of them or a few more.

    Both ends lie in gaps of the spectrum that inertia counts have found; the interval is as short as they allow, so
    that the filter tells its eigenvalues from the next one. Eigenvalues too close to each other for a gap are taken
    in together.
    """
    size = len(matrix)
    bound = float(np.abs(matrix).sum(1).max()) * (1 + 1e-6)  # no eigenvalue is larger in absolute value
    fine, form = bound * 1e-9, tridiagonal(matrix)
    first = _edge(form, 1, -bound, bound, fine)
    above, best = _edge(form, wanted, -bound, first[1], fine), None
    for count in range(wanted, size):
        below = _edge(form, count + 1, -bound, above[1], fine)
        gap = above[0] - below[1]
        if gap > 10 * fine and (best is None or gap > best[0]):
            best = (gap, (above[0] + below[1]) / 2, count)
        # A gap of a tenth of the interval is wide enough, and a few more eigenvalues are enough to look for one.
        if best and (best[0] >= (first[1] - best[1]) / 10 or count >= wanted + 3):
            return best[1], first[1] + best[0] / 2, count_above(form, best[1])
        above = below
    return (best[1], first[1] + best[0] / 2, best[2]) if best else (-bound * 1.01, bound * 1.01, size)


def eigenpairs_inside(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their unit eigenvectors as columns.

    The block of vectors grows while the residuals do not reach rounding.
    """
    size = len(matrix)
    rng = np.random.default_rng(12)  # starting vectors; the result does not depend on them beyond rounding
    basis = rng.standard_normal((size, min(size, 2 * count + 4)))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (nodes + 1)  # the upper half of the circle; the lower half is its conjugate
    shifts = centre + radius * np.exp(1j * angles)
    inverses = [np.linalg.inv(z * np.eye(size) - matrix) for z in shifts]
    scale = float(np.abs(matrix).sum(1).max()) or 1.0
    best = np.inf
    for at in range(1, MOST_PASSES + 1):
        filtered = np.zeros((size, basis.shape[1]))
        for inverse, weight, angle in zip(inverses, weights, angles):
            filtered += (weight / 2 * radius * np.exp(1j * angle) * (inverse @ basis)).real
        left, strength, _ = np.linalg.svd(filtered, full_matrices=False)
        basis = left[:, strength > strength[0] * 1e-14]
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turn
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        residual = np.linalg.norm(matrix @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0)
        if len(inside) == count and residual <= 1e-14 * scale * size and residual >= best / 2:
            return values[inside], basis[:, inside]  # at rounding, and another pass has not made it better
        if len(inside) == count:
            best = min(best, residual)
        if at % GROW_AFTER == 0:
            more = min(size, 2 * basis.shape[1]) - basis.shape[1]
            basis = np.concatenate([basis, rng.standard_normal((size, more))], axis=1)
    raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}); {len(inside)} were found, residual {residual}")


def largest_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, len(matrix))
    if not wanted or not np.any(matrix):
        return np.zeros(wanted), np.eye(len(matrix))[:, :wanted]
    low, high, count = interval_of_largest(matrix, wanted)
    values, vectors = eigenpairs_inside(matrix, low, high, count)
    return values[:wanted], vectors[:, :wanted]
