"""Taper windows as column expressions of a position and a length; a window of length 1 is 1, positions outside give NULL."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cosine coefficients of the windows that are sums of cosines.
COSINES = {"hanning": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08)}


def _within(k: Column, n: int, value: Callable[[Column], Column]) -> Column:
    x = k.cast("double") / float(max(n - 1, 1))
    return F.when((k >= 0) & (k < n), F.lit(1.0) if n == 1 else value(x))


def cosine_sum(k: Column, n: int, coefficients: tuple[float, ...]) -> Column:
    return _within(k, n, lambda x: sum((F.cos(x * (2 * pi * j)) * c for j, c in enumerate(coefficients) if j), F.lit(coefficients[0])))


def hanning(k: Column, n: int) -> Column:
    return cosine_sum(k, n, COSINES["hanning"])


def hamming(k: Column, n: int) -> Column:
    return cosine_sum(k, n, COSINES["hamming"])


def blackman(k: Column, n: int) -> Column:
    return cosine_sum(k, n, COSINES["blackman"])


def bartlett(k: Column, n: int) -> Column:
    return _within(k, n, lambda x: 1 - F.abs(2 * x - 1))
