"""Algebra of polynomial series in six bases, on coefficient sequences (low order first), with values as expressions.

Coefficients are small and known when a query is written, so their algebra runs beforehand; what it gives becomes part of
the plan.  Every basis has one three-term recurrence, from which products, bases' changes, derivatives and quadratures follow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.poly import _RECURRENCE, series_value

KINDS = ("power", *_RECURRENCE)


def _step(kind: str, k: int) -> tuple[float, float, float]:
    """p(k+1) = (a x + b) p(k) - c p(k-1)."""
    if kind == "power":
        return 1.0, 0.0, 0.0
    if not k:
        return {"chebyshev": (1.0, 0.0, 0.0), "legendre": (1.0, 0.0, 0.0), "hermite": (2.0, 0.0, 0.0), "hermite_e": (1.0, 0.0, 0.0), "laguerre": (-1.0, 1.0, 0.0)}[kind]
    return _RECURRENCE[kind][1](k)


def trimmed(c: Sequence[float], tol: float = 0.0) -> np.ndarray:
    c = np.atleast_1d(np.asarray(c, float))
    keep = np.flatnonzero(np.abs(c) > tol)
    return c[: keep[-1] + 1] if len(keep) else c[:1] * 0


def add(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)))
    out[: len(a)] += a
    out[: len(b)] += b
    return trimmed(out)


def sub(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    return add(a, -np.asarray(b, float))


def mulx(c: Sequence[float], kind: str = "power") -> np.ndarray:
    """The series times x: the recurrence solved for x p(k)."""
    c = np.asarray(c, float)
    out = np.zeros(len(c) + 1)
    for k, x in enumerate(c):
        a, b, low = _step(kind, k)
        out[k + 1] += x / a
        out[k] -= x * b / a
        if k:
            out[k - 1] += x * low / a
    return trimmed(out)


def to_power(c: Sequence[float], kind: str) -> np.ndarray:
    """The same polynomial in powers of x, by Clenshaw's scheme."""
    c = np.asarray(c, float)
    b1, b2 = np.zeros(1), np.zeros(1)
    for k in range(len(c) - 1, -1, -1):
        a, b, _ = _step(kind, k)
        low = _step(kind, k + 1)[2]
        b1, b2 = add(add([c[k]], add(np.concatenate([[0.0], a * b1]), b * b1)), -low * b2), b1
    return trimmed(b1)


def from_power(c: Sequence[float], kind: str) -> np.ndarray:
    """A polynomial in powers of x as a series, by Horner's rule."""
    out = np.zeros(1)
    for x in reversed(np.asarray(c, float)):
        out = add(mulx(out, kind), [x])
    return trimmed(out)


def mul(a: Sequence[float], b: Sequence[float], kind: str = "power") -> np.ndarray:
    """The product, by Horner's rule over one factor's recurrence."""
    a, b = trimmed(a), trimmed(b)
    before, now, out = np.zeros(1), b, np.zeros(1)
    for k, x in enumerate(a):
        out = add(out, x * now)
        s, t, low = _step(kind, k)
        before, now = now, sub(add(s * mulx(now, kind), t * now), low * before)
    return trimmed(out)


def power(c: Sequence[float], n: int, kind: str = "power") -> np.ndarray:
    out = np.ones(1)
    for _ in range(n):
        out = mul(out, c, kind)
    return out


def divide(a: Sequence[float], b: Sequence[float], kind: str = "power") -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder."""
    a, b = trimmed(a), trimmed(b)
    if not b.any():
        raise ZeroDivisionError("division by the zero polynomial")
    rest, out = a, np.zeros(max(len(a) - len(b) + 1, 1))
    while len(rest) >= len(b) and rest.any():
        k = len(rest) - len(b)
        term = np.zeros(k + 1)
        term[k] = 1.0
        shifted = mul(term, b, kind)
        out[k] = rest[-1] / shifted[-1]
        rest = trimmed((rest - out[k] * shifted)[:-1]) if len(rest) > 1 else np.zeros(1)
    return trimmed(out), rest


def derivative(c: Sequence[float], m: int = 1, kind: str = "power", scale: float = 1.0) -> np.ndarray:
    c = to_power(c, kind)
    for _ in range(m):
        c = c[1:] * np.arange(1, len(c)) * scale if len(c) > 1 else np.zeros(1)
    return from_power(c, kind)


def integral(c: Sequence[float], m: int = 1, kind: str = "power", constants: Sequence[float] = (), lower: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """m-fold integral; each is its constant at ``lower``."""
    c = to_power(c, kind)
    for i in range(m):
        c = np.concatenate([[0.0], c * scale / np.arange(1, len(c) + 1)])
        c[0] = (constants[i] if i < len(constants) else 0.0) - np.polyval(c[::-1], lower)
    return from_power(c, kind)


def from_roots(roots: Sequence[float], kind: str = "power") -> np.ndarray:
    out = np.ones(1)
    for r in roots:
        out = sub(mulx(out, kind), r * out)
    return out


def companion(c: Sequence[float], kind: str = "power") -> np.ndarray:
    """The matrix of multiplication by x modulo the polynomial; its eigenvalues are the roots."""
    c = trimmed(c)
    n = len(c) - 1
    out = np.zeros((n, n))
    for k in range(n):
        unit = np.zeros(k + 1)
        unit[k] = 1.0
        column = mulx(unit, kind)
        column = np.concatenate([column, np.zeros(max(n + 1 - len(column), 0))])
        out[:, k] = column[:n] - column[n] * c[:n] / c[n]
    return out


def roots(c: Sequence[float], kind: str = "power") -> np.ndarray:
    c = trimmed(c)
    return np.sort(np.linalg.eigvals(companion(c, kind))) if len(c) > 1 else np.zeros(0)


def line(offset: float, slope: float, kind: str = "power") -> np.ndarray:
    return from_power([offset, slope], kind)


def gauss(n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights that integrate polynomials of degree 2 n - 1 against the basis's own weight exactly; rising, Chebyshev's falling."""
    total = {"chebyshev": np.pi, "legendre": 2.0, "hermite": np.sqrt(np.pi), "hermite_e": np.sqrt(2 * np.pi), "laguerre": 1.0}[kind]
    steps = [_step(kind, k) for k in range(n)]
    middle = np.array([-b / a for a, b, _ in steps])
    side = np.array([np.sqrt(steps[k][2] / (steps[k][0] * steps[k - 1][0])) for k in range(1, n)])
    nodes, vectors = np.linalg.eigh(np.diag(middle) + np.diag(side, 1) + np.diag(side, -1))
    weights = total * vectors[0] ** 2
    return (nodes[::-1], weights[::-1]) if kind == "chebyshev" else (nodes, weights)


def weight(x: Column, kind: str) -> Column:
    """The basis's weight at x."""
    x = x.cast("double")
    return {"chebyshev": 1 / F.sqrt((1 - x) * (1 + x)), "legendre": F.lit(1.0), "hermite": F.exp(-x * x), "hermite_e": F.exp(-x * x / 2), "laguerre": F.exp(-x)}[kind]


def chebyshev_points(n: int, ends: bool = False) -> np.ndarray:
    """The n points of the first kind, or with ``ends`` of the second, rising."""
    return -np.cos(np.pi * np.arange(n) / (n - 1)) if ends else np.sin(np.pi * (2 * np.arange(n) - n + 1) / (2 * n))


def value(c: Sequence[float], x: Column, kind: str = "power") -> Column:
    return series_value(x, list(map(float, c)), kind)


def value_nd(c, xs: Sequence[Column], kind: str = "power") -> Column:
    """A series in several variables; ``c`` is nested as deep as there are variables."""
    c = np.asarray(c, float)
    if len(xs) == 1:
        return value(c, xs[0], kind)
    from gridloom.operators.poly import basis

    first = basis(xs[0], len(c) - 1, kind)
    return sum((b * value_nd(row, xs[1:], kind) for b, row in zip(first, c, strict=True)), F.lit(0.0))


def vander_nd(xs: Sequence[Column], degrees: Sequence[int], kind: str = "power") -> list[Column]:
    """Products of the bases, the last variable's degree running fastest."""
    from gridloom.operators.poly import basis

    out = [F.lit(1.0)]
    for x, d in zip(xs, degrees, strict=True):
        out = [a * b for a in out for b in basis(x, d, kind)]
    return out


def map_domain(x, old: Sequence[float], new: Sequence[float]):
    """The line that takes the old interval to the new one, at x (a number or a column)."""
    scale = (new[1] - new[0]) / (old[1] - old[0])
    return x * scale + (new[0] - old[0] * scale)
