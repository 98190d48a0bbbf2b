"""Layout operators on coordinate tables: they re-key rows and move no values between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.indexing import ravel_multi_index, unravel_index


def transpose(df: DataFrame, axes: Sequence[str], order: Sequence[int]) -> DataFrame:
    return df.select(*[F.col(axes[o]).alias(a) for a, o in zip(axes, order, strict=True)], *[c for c in df.columns if c not in axes])


def reshape(df: DataFrame, axes: Sequence[str], shape: Sequence[int], new_axes: Sequence[str], new_shape: Sequence[int]) -> DataFrame:
    flat = ravel_multi_index([F.col(a) for a in axes], shape)
    return df.select(*[c.cast("long").alias(a) for a, c in zip(new_axes, unravel_index(flat, new_shape), strict=True)], *[c for c in df.columns if c not in axes])


def ravel(df: DataFrame, axes: Sequence[str], shape: Sequence[int], idx: str = "idx") -> DataFrame:
    return df.select(ravel_multi_index([F.col(a) for a in axes], shape).alias(idx), *[c for c in df.columns if c not in axes])


def flip(df: DataFrame, axis: str, n: int) -> DataFrame:
    return df.withColumn(axis, F.lit(n - 1) - F.col(axis))


def rot90(df: DataFrame, i: str, j: str, rows: int, cols: int, k: int = 1) -> DataFrame:
    for _ in range(k % 4):
        df = df.withColumn("__i", F.lit(cols - 1) - F.col(j)).withColumn(j, F.col(i)).withColumn(i, F.col("__i")).drop("__i")
        rows, cols = cols, rows
    return df


def concatenate(parts: Sequence[DataFrame], axis: str, sizes: Sequence[int]) -> DataFrame:
    out, at = None, 0
    for p, n in zip(parts, sizes, strict=True):
        moved = p.withColumn(axis, F.col(axis) + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def stack(parts: Sequence[DataFrame], axis: str) -> DataFrame:
    out = None
    for k, p in enumerate(parts):
        part = p.withColumn(axis, F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def split(df: DataFrame, axis: str, cuts: Sequence[int]) -> list[DataFrame]:
    edges = [0, *cuts, None]
    out = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        rows = df.where(F.col(axis) >= a)
        rows = rows if z is None else rows.where(F.col(axis) < z)
        out.append(rows.withColumn(axis, F.col(axis) - a))
    return out


def repeat(df: DataFrame, axis: str, times: int) -> DataFrame:
    return df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) * times + F.col("__k")).drop("__k")


def tile(df: DataFrame, axis: str, n: int, times: int) -> DataFrame:
    return df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) + F.col("__k") * n).drop("__k")


def resize(df: DataFrame, axis: str, n: int, size: int) -> DataFrame:
    return tile(df, axis, n, -(-size // n)).where(F.col(axis) < size)


def pad(df: DataFrame, axis: str, n: int, before: int, after: int, mode: str = "constant", value=0, v: str = "v") -> DataFrame:
    """Borders along one axis; all modes but constant copy the row that a border place maps to."""
    others = [c for c in df.columns if c not in (axis, v)]
    inner = df.withColumn(axis, F.col(axis) + before)
    places = [*range(before), *range(before + n, before + n + after)]
    if not places:
        return inner
    if mode == "constant":
        lines = df.select(*others).distinct() if others else df.sparkSession.range(1).select()
        border = lines.withColumn(axis, F.explode(F.array(*[F.lit(p).cast("long") for p in places]))).withColumn(v, F.lit(value))
        return inner.unionByName(border.select(*inner.columns))
    period = {"reflect": max(2 * n - 2, 1), "symmetric": 2 * n, "wrap": n}.get(mode)

    def source(p: int) -> int:
        k = p - before
        if mode == "edge":
            return min(max(k, 0), n - 1)
        k %= period
        return k if k < n else (period - k if mode == "reflect" else period - 1 - k)

    pairs = df.sparkSession.createDataFrame([(source(p), p) for p in places], "__s long, __p long")
    border = df.join(F.broadcast(pairs), F.col(axis) == F.col("__s")).withColumn(axis, F.col("__p")).drop("__s", "__p")
    return inner.unionByName(border.select(*inner.columns))


def diagonal(df: DataFrame, i: str, j: str, offset: int = 0) -> DataFrame:
    return df.where(F.col(j) - F.col(i) == offset)


def tril(df: DataFrame, i: str, j: str, v: str, k: int = 0) -> DataFrame:
    return df.withColumn(v, F.when(F.col(j) - F.col(i) <= k, F.col(v)).otherwise(0))


def triu(df: DataFrame, i: str, j: str, v: str, k: int = 0) -> DataFrame:
    return df.withColumn(v, F.when(F.col(j) - F.col(i) >= k, F.col(v)).otherwise(0))


def trim_zeros(df: DataFrame, idx: str, v: str) -> DataFrame:
    ends = df.where(F.col(v) != 0).agg(F.min(idx).alias("__a"), F.max(idx).alias("__z"))
    return df.crossJoin(F.broadcast(ends)).where(F.col(idx).between(F.col("__a"), F.col("__z"))).withColumn(idx, F.col(idx) - F.col("__a")).drop("__a", "__z")
