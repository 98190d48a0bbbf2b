"""Selection and element updates on long-form arrays with a dense index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_rows(df: DataFrame, idx: str, start: int = 0, stop: int | None = None, step: int = 1, n: int | None = None) -> DataFrame:
    """``a[start:stop:step]``, re-indexed; negative bounds and steps need the length."""
    if n is not None:
        start, stop, step = slice(start if start else None if step < 0 else start, stop, step).indices(n)
    if step > 0:
        rows = df.where((F.col(idx) >= start) & ((F.col(idx) - start) % step == 0))
        rows = rows if stop is None else rows.where(F.col(idx) < stop)
    else:
        rows = df.where((F.col(idx) <= start) & (F.col(idx) > (-1 if stop is None else stop)) & ((start - F.col(idx)) % -step == 0))
    return rows.withColumn(idx, ((F.col(idx) - start) / step).cast("long"))


def _mode(i: Column, n: int, mode: str) -> Column:
    if mode == "wrap":
        return F.pmod(i, F.lit(n))
    if mode == "clip":
        return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0))
    fixed = F.when(i < 0, i + n).otherwise(i)
    return F.when((fixed < 0) | (fixed >= n), F.raise_error(F.lit("index out of bounds"))).otherwise(fixed)


def take(df: DataFrame, idx: str, picks: DataFrame, pick: str, n: int, mode: str = "raise") -> DataFrame:
    """Gather: every pick beside the row it points to (an equi join)."""
    wanted = picks.withColumn("__i", _mode(F.col(pick).cast("long"), n, mode))
    return wanted.join(df.withColumnRenamed(idx, "__i"), "__i").drop("__i")


def put(df: DataFrame, idx: str, v: str, updates: DataFrame, order: str) -> DataFrame:
    """Scatter: the last update of an index (by ``order``) replaces its value."""
    last = updates.groupBy(idx).agg(F.max(F.struct(order, v)).alias("__u")).select(idx, F.col("__u")[v].alias("__v"), F.lit(True).alias("__hit"))
    return df.join(last, idx, "left").withColumn(v, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(v))).drop("__v", "__hit")


def putmask(v: Column, mask: Column, new: Column) -> Column:
    return F.when(mask, new).otherwise(v)


def compress(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)


def extract(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)


def where(cond: Column, a, b) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(cond, lit(a)).otherwise(lit(b))


def choose(i: Column, choices: Sequence, mode: str = "raise") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.element_at(F.array(*[lit(c) for c in choices]), (_mode(i, len(choices), mode) + 1).cast("int"))


def select(conditions: Sequence[Column], values: Sequence, default=0) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for c, v in reversed(list(zip(conditions, values, strict=True))):
        out = where(c, v, out)
    return out


def piecewise(x: Column, conditions: Sequence[Column], functions: Sequence, otherwise=0) -> Column:
    return select(conditions, [f(x) if callable(f) else f for f in functions], otherwise)


def nonzero(df: DataFrame, v: str) -> DataFrame:
    return df.where(F.col(v) != 0)


def delete(df: DataFrame, idx: str, gone: DataFrame) -> DataFrame:
    """Without the listed indices, re-indexed."""
    from gridloom.operators.scan import row_index

    return row_index(df.join(gone.select(idx).distinct(), idx, "left_anti").withColumnRenamed(idx, "__old"), ["__old"], idx).drop("__old")


def insert(df: DataFrame, idx: str, v: str, at: int, values: Sequence) -> DataFrame:
    k = len(values)
    moved = df.select(F.when(F.col(idx) >= at, F.col(idx) + k).otherwise(F.col(idx)).alias(idx), v)
    new = df.sparkSession.createDataFrame([(at + i, x) for i, x in enumerate(values)], moved.schema)
    return moved.unionByName(new)


def unravel_index(i: Column, shape: Sequence[int]) -> list[Column]:
    out, rest = [], i
    for size in reversed(shape):
        out.append(rest % size)
        rest = F.floor(rest / size)
    return list(reversed(out))


def ravel_multi_index(axes: Sequence[Column], shape: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for a, size in zip(axes, shape, strict=True):
        out = out * size + a
    return out
