"""Set operations on one column; NaN equals nothing except in ``unique``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import row_index


def _plain(df: DataFrame, v: str) -> DataFrame:
    """The column with negative zero made zero."""
    x = F.col(v)
    return df.select((x + 0.0 if dict(df.dtypes)[v] in ("double", "float") else x).alias(v))


def _numbers(df: DataFrame, v: str) -> DataFrame:
    out = _plain(df, v)
    return out.where(~F.isnan(F.col(v))) if dict(df.dtypes)[v] in ("double", "float") else out


def unique(df: DataFrame, v: str, idx: str | None = None) -> DataFrame:
    """value, count and, with an index, the first index of each distinct value."""
    extra = [F.min(idx).alias("index")] if idx else []
    return df.groupBy(F.col(v).alias("value")).agg(F.count("*").alias("count"), *extra)


def unique_inverse(df: DataFrame, v: str) -> DataFrame:
    """The rows with the place of their value among the sorted distinct ones."""
    places = row_index(df.select(v).distinct(), [v], "inverse")
    return df.join(places, v)


def union1d(a: DataFrame, b: DataFrame, v: str) -> DataFrame:
    return _plain(a, v).union(_plain(b, v)).distinct()


def intersect1d(a: DataFrame, b: DataFrame, v: str) -> DataFrame:
    return _numbers(a, v).intersect(_numbers(b, v))


def setdiff1d(a: DataFrame, b: DataFrame, v: str) -> DataFrame:
    return _plain(a, v).distinct().join(_numbers(b, v).distinct(), v, "left_anti")


def setxor1d(a: DataFrame, b: DataFrame, v: str) -> DataFrame:
    return setdiff1d(a, b, v).union(setdiff1d(b, a, v))


def isin(df: DataFrame, v: str, test: DataFrame, w: str, invert: bool = False) -> DataFrame:
    """The rows whose value is (not) in the other column, by a semi (anti) join."""
    keys = _numbers(test, w).distinct().select(F.col(w).alias("__k"))
    return df.join(keys, F.col(v) == F.col("__k"), "left_anti" if invert else "left_semi")
