"""Masked arrays: NULL is a masked cell; ``(data, mask)`` structs keep what lies under the mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_where(cond: Column, v: Column) -> Column:
    return F.when(~cond | cond.isNull(), v)


def masked_equal(v: Column, x) -> Column:
    return masked_where(v == x, v)


def masked_not_equal(v: Column, x) -> Column:
    return masked_where(v != x, v)


def masked_greater(v: Column, x) -> Column:
    return masked_where(v > x, v)


def masked_greater_equal(v: Column, x) -> Column:
    return masked_where(v >= x, v)


def masked_less(v: Column, x) -> Column:
    return masked_where(v < x, v)


def masked_less_equal(v: Column, x) -> Column:
    return masked_where(v <= x, v)


def masked_inside(v: Column, a, b) -> Column:
    return masked_where((v >= min(a, b)) & (v <= max(a, b)), v)


def masked_outside(v: Column, a, b) -> Column:
    return masked_where((v < min(a, b)) | (v > max(a, b)), v)


def masked_values(v: Column, x: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return masked_where(F.abs(v - x) <= atol + rtol * abs(x), v)


def masked_invalid(v: Column) -> Column:
    d = v.cast("double")
    return masked_where(F.isnan(d) | (F.abs(d) == float("inf")), v)


def filled(v: Column, fill) -> Column:
    return F.coalesce(v, F.lit(fill))


def pack(v: Column, mask: Column) -> Column:
    return F.struct(v.alias("data"), mask.alias("mask"))


def unpack(cell: Column) -> Column:
    return F.when(~cell["mask"], cell["data"])


def count(v: str) -> Column:
    return F.count(v)


def count_masked(v: str) -> Column:
    return F.count_if(F.col(v).isNull())


def anom(df: DataFrame, v: str, by: Sequence[str], out: str = "value") -> DataFrame:
    """Deviation from the mean of the line."""
    return df.withColumn(out, F.col(v) - F.avg(v).over(Window.partitionBy(*by)))


def compress_rows(df: DataFrame, v: str, row: str) -> DataFrame:
    """Rows (of a coordinate table) without any masked cell."""
    bad = df.where(F.col(v).isNull()).select(row).distinct()
    return df.join(bad, row, "left_anti")


def mask_rowcols(df: DataFrame, v: str, axes: Sequence[str]) -> DataFrame:
    """Masks every line, along the given axes, that holds a masked cell."""
    out = df
    for a in axes:
        bad = df.where(F.col(v).isNull()).select(a).distinct().withColumn("__bad", F.lit(True))
        out = out.join(bad, a, "left").withColumn(v, F.when(F.col("__bad").isNull(), F.col(v))).drop("__bad")
    return out


def clumps(df: DataFrame, v: str, idx: str, by: Sequence[str], masked: bool = False) -> DataFrame:
    """Runs of adjacent (un)masked cells: first, last and length of each."""
    keep = F.col(v).isNull() if masked else F.col(v).isNotNull()
    w = Window.partitionBy(*by).orderBy(idx)
    rows = df.where(keep).withColumn("__g", F.col(idx) - F.row_number().over(w))
    return rows.groupBy(*by, "__g").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("length")).drop("__g")


def notmasked_edges(df: DataFrame, v: str, idx: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(v).isNotNull()).groupBy(*by).agg(F.min(idx).alias("first"), F.max(idx).alias("last"))


def mask_or(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


#: The least normal double: a quotient is masked where its divisor is no larger than this times its dividend.
TINY = 2.2250738585072014e-308


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def masked_function(name: str, x: Column) -> Column:
    """A function with a domain: cells outside it, and cells whose value is not finite, are masked."""
    x = x.cast("double")
    edge = 1 - 1e-15
    inside, value = {
        "log": (x > 0, F.log(x)),
        "log2": (x > 0, F.log2(x)),
        "log10": (x > 0, F.log10(x)),
        "sqrt": (x >= 0, F.sqrt(x)),
        "arcsin": (F.abs(x) <= 1, F.asin(x)),
        "arccos": (F.abs(x) <= 1, F.acos(x)),
        "arccosh": (x >= 1, F.acosh(x)),
        "arctanh": (F.abs(x) <= edge, F.atanh(x)),
        "tan": (F.abs(F.cos(x)) >= 1e-35, F.tan(x)),
    }[name]
    return F.when(inside, _finite(value))


def masked_divide(name: str, a: Column, b: Column) -> Column:
    """divide, floor_divide, remainder (the divisor's sign) or fmod (the dividend's), masked where the divisor is as good as zero."""
    a, b = a.cast("double"), b.cast("double")
    fmod = a % b
    safe = F.abs(a) * TINY < F.abs(b)
    value = {
        "divide": a / b,
        "floor_divide": (a - F.when((fmod != 0) & ((fmod < 0) != (b < 0)), fmod + b).otherwise(fmod)) / b,
        "remainder": F.when((fmod != 0) & ((fmod < 0) != (b < 0)), fmod + b).otherwise(fmod),
        "fmod": fmod,
    }[name]
    return F.when(safe, _finite(F.rint(value) if name == "floor_divide" else value))


def cov(df: DataFrame, x: str, y: str, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Covariance and correlation over the rows where neither cell is masked; NULL where too few remain."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    value = F.when(n > ddof, F.covar_pop(x, y) * n / (n - ddof))
    return both.groupBy(*by).agg(n.alias("n"), value.alias("cov"), F.corr(x, y).alias("corr"))


def average(df: DataFrame, v: str, weights: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and the sum of the weights that count: those of cells that are not masked."""
    w = F.when(F.col(v).isNotNull(), F.col(weights))
    return df.groupBy(*by).agg((F.sum(F.col(v) * w) / F.sum(w)).alias("average"), F.sum(w).alias("weight"))
