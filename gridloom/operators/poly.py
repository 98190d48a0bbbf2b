"""Polynomials as expressions: coefficients are literals or one array column, low order first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polyval(x: Column, coef: Sequence[float]) -> Column:
    """Horner's rule, coefficients from low to high order."""
    out = F.lit(0.0)
    for c in reversed(list(coef)):
        out = out * x + float(c)
    return out


#: p(k+1) = (a(k) x + b(k)) p(k) - c(k) p(k-1), with p(0) = 1 and p(1) = first(x).
_RECURRENCE = {
    "chebyshev": (lambda x: x, lambda k: (2.0, 0.0, 1.0)),
    "legendre": (lambda x: x, lambda k: ((2 * k + 1) / (k + 1), 0.0, k / (k + 1))),
    "hermite": (lambda x: 2 * x, lambda k: (2.0, 0.0, 2.0 * k)),
    "hermite_e": (lambda x: x, lambda k: (1.0, 0.0, float(k))),
    "laguerre": (lambda x: 1 - x, lambda k: (-1.0 / (k + 1), (2 * k + 1) / (k + 1), k / (k + 1))),
}


def basis(x: Column, degree: int, kind: str = "power") -> list[Column]:
    """The basis polynomials of degree 0 … ``degree`` at x (a Vandermonde row)."""
    x = x.cast("double")
    if kind == "power":
        out = [F.lit(1.0)]
        for _ in range(degree):
            out.append(out[-1] * x)
        return out
    first, step = _RECURRENCE[kind]
    out = [F.lit(1.0), first(x)]
    for k in range(1, degree):
        a, b, c = step(k)
        out.append((x * a + b) * out[k] - out[k - 1] * c)
    return out[: degree + 1]


def series_value(x: Column, coef: Sequence[float], kind: str = "power") -> Column:
    return sum((b * float(c) for b, c in zip(basis(x, len(coef) - 1, kind), coef, strict=True)), F.lit(0.0))


def fit(df: DataFrame, x: str, y: str, degree: int, kind: str = "power"):
    """Least-squares coefficients, low order first, from one pass of sums."""
    from gridloom.operators.linalg import lstsq_gram

    names = [f"__b{k}" for k in range(degree + 1)]
    rows = df.select(*[b.alias(n) for b, n in zip(basis(F.col(x), degree, kind), names, strict=True)], F.col(y).cast("double").alias("__y"))
    return lstsq_gram(rows, "__y", names)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def mul(a: Column, b: Column) -> Column:
    """Product of two coefficient arrays."""
    place = F.sequence(F.lit(0), F.size(a) + F.size(b) - 2)
    cell = lambda k: F.aggregate(F.sequence(F.greatest(k - F.size(b) + 1, F.lit(0)), F.least(k, F.size(a) - 1)), F.lit(0.0), lambda s, i: s + F.element_at(a, i + 1) * F.element_at(b, k - i + 1))
    return F.transform(place, cell)


def deriv(a: Column) -> Column:
    return F.when(F.size(a) <= 1, F.array(F.lit(0.0))).otherwise(F.transform(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda c, i: c * (i + 1)))


def integ(a: Column, constant: float = 0.0) -> Column:
    return F.concat(F.array(F.lit(constant)), F.transform(a, lambda c, i: c / (i + 1)))


def trim(a: Column, tol: float = 0.0) -> Column:
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(F.abs(F.element_at(a, i)) > tol, i).otherwise(1)))
    return F.slice(a, F.lit(1), last)


def roots(df: DataFrame, coef: str) -> DataFrame:
    """Adds arrays ``root_re``, ``root_im`` (companion matrix eigenvalues, ascending)."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("root_re", ArrayType(DoubleType())), StructField("root_im", ArrayType(DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.float64())
        for batch in batches:
            found = [np.sort_complex(np.polynomial.polynomial.polyroots(np.asarray(c, float))) if c else np.zeros(0) for c in batch[coef].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.real.tolist() for r in found], kind), pa.array([r.imag.tolist() for r in found], kind)], [*batch.schema.names, "root_re", "root_im"])

    return df.mapInArrow(run, schema)
