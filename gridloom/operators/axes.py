"""Reductions along named axes, axis-wise gather and scatter, and shape helpers on coordinate tables.

An array is a table of index columns (its axes) and a value column; ``axis`` names the axes that are reduced, all by
default.  ``where`` is a condition on the elements, ``initial`` joins the elements, ``keepdims`` keeps a reduced axis at 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import reduce as r
from gridloom.operators.scan import cumulative

#: What joins an ``initial`` value to a reduced one.
_JOIN: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest}
REDUCTIONS: dict[str, Callable[..., Column]] = {
    "sum": r.total, "prod": r.product, "min": r.amin, "max": r.amax, "mean": r.mean, "var": r.var, "std": r.std, "ptp": r.ptp, "all": r.all_, "any": r.any_,
    "count_nonzero": r.count_nonzero, "median": r.median, "nansum": r.nansum, "nanprod": r.nanprod, "nanmin": r.nanmin, "nanmax": r.nanmax, "nanmean": r.nanmean, "nanvar": r.nanvar, "nanstd": r.nanstd, "nanmedian": r.nanmedian,
}
_PLACES = {"argmin": r.argmin, "argmax": r.argmax, "nanargmin": r.nanargmin, "nanargmax": r.nanargmax}


def reduce_axes(df: DataFrame, name: str, v: str, axes: Sequence[str], axis: Sequence[str] | str | None = None, *, where: Column | None = None, initial=None, keepdims: bool = False, dtype: str | None = None, **options) -> DataFrame:
    """The reduction ``name`` along ``axis``; one row per place of the other axes (one row for all)."""
    gone = list(axes) if axis is None else [axis] if isinstance(axis, str) else list(axis)
    stay = [a for a in axes if a not in gone]
    x = F.col(v) if dtype is None else F.col(v).cast(dtype)
    if where is not None:
        x = F.when(where, x)
    out = REDUCTIONS[name](x, **options)
    if initial is not None:
        out = F.coalesce(_JOIN[name](out, F.lit(initial)), F.lit(initial))
    rows = df.groupBy(*stay).agg(out.alias(v)) if stay else df.agg(out.alias(v))
    return rows.select(*[F.lit(0).cast("long").alias(a) if a in gone else F.col(a) for a in axes], v) if keepdims else rows


def place_along(df: DataFrame, name: str, v: str, axes: Sequence[str], axis: str) -> DataFrame:
    """argmin, argmax and their nan versions along one axis: the axis's index of the first such element."""
    stay = [a for a in axes if a != axis]
    return df.groupBy(*stay).agg(_PLACES[name](v, axis).alias("place"))


def reduce_over(df: DataFrame, names: Sequence[str], v: str, axes: Sequence[str], axis: Sequence[str]) -> DataFrame:
    """One reduction after the other, each along its own axis, the axes kept at 0."""
    for name, a in zip(names, axis, strict=True):
        df = reduce_axes(df, name, v, axes, a, keepdims=True)
    return df


def cumulative_along(df: DataFrame, v: str, axes: Sequence[str], axis: str, kind: str = "sum", out: str = "value") -> DataFrame:
    return cumulative(df, v, axis, out, [a for a in axes if a != axis], kind) if len(axes) > 1 else cumulative(df, v, axis, out, (), kind)


# Gather and scatter along an axis ------------------------------------------------------------------------------------


def take_along_axis(df: DataFrame, picks: DataFrame, axes: Sequence[str], axis: str, v: str = "v", pick: str = "pick", n: int | None = None) -> DataFrame:
    """``picks`` has the axes and a column of indices along ``axis``: each place gets the value found there (an equi join)."""
    at = F.col(pick) if n is None else F.when(F.col(pick) < 0, F.col(pick) + n).otherwise(F.col(pick))
    wanted = picks.select(*axes, at.alias("__at"))
    source = df.select(*[F.col(a).alias("__at" if a == axis else a) for a in axes], v)
    return wanted.join(source, [*[a for a in axes if a != axis], "__at"], "left").select(*axes, v)


def put_along_axis(df: DataFrame, picks: DataFrame, axes: Sequence[str], axis: str, v: str = "v", pick: str = "pick", new: str = "new") -> DataFrame:
    """Values are written where the picks point; the pick latest along ``axis`` wins."""
    others = [a for a in axes if a != axis]
    last = picks.groupBy(*others, F.col(pick).alias("__at")).agg(F.max(F.struct(F.col(axis).alias("o"), F.col(new).alias("x"))).alias("__u"))
    last = last.select(*others, F.col("__at").alias(axis), F.col("__u.x").alias("__x"), F.lit(True).alias("__hit"))
    return df.join(last, list(axes), "left").withColumn(v, F.when(F.col("__hit"), F.col("__x")).otherwise(F.col(v))).drop("__x", "__hit")


def argwhere(df: DataFrame, v: str, axes: Sequence[str]) -> DataFrame:
    """The index rows of the elements that aren't zero."""
    return df.where(F.col(v) != 0).select(*axes)


def flatnonzero(df: DataFrame, v: str, axes: Sequence[str], shape: Sequence[int]) -> DataFrame:
    from gridloom.operators.indexing import ravel_multi_index

    return df.where(F.col(v) != 0).select(ravel_multi_index([F.col(a) for a in axes], shape).alias("idx"))


def place(df: DataFrame, mask: Column, values: Sequence, idx: str, v: str) -> DataFrame:
    """The k-th element under the mask gets the k-th value, over and over."""
    from gridloom.operators.scan import row_index

    hit = row_index(df.where(mask).select(idx), [idx], "__k")
    new = F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("__k") % len(values) + 1).cast("int"))
    return df.join(hit, idx, "left").withColumn(v, F.when(F.col("__k").isNotNull(), new).otherwise(F.col(v))).drop("__k")


def copyto(v: Column, new: Column, where: Column | None = None) -> Column:
    return new if where is None else F.when(where, new).otherwise(v)


def fill_diagonal(df: DataFrame, i: str, j: str, v: str, value) -> DataFrame:
    return df.withColumn(v, F.when(F.col(i) == F.col(j), F.lit(value)).otherwise(F.col(v)))


def diag(df: DataFrame, idx: str, v: str, k: int = 0) -> DataFrame:
    """A vector as the k-th diagonal of a matrix; absent cells are zeros."""
    return df.select((F.col(idx) + max(-k, 0)).alias("i0"), (F.col(idx) + max(k, 0)).alias("i1"), v)


def triangle(spark, n: int, m: int | None = None, k: int = 0, lower: bool = True) -> DataFrame:
    """Index pairs of the lower (upper) triangle of an n x m matrix, each row's share of it made where it is needed."""
    m = n if m is None else m
    rows = spark.range(n).select(F.col("id").alias("i0"))
    first = F.lit(0).cast("long") if lower else F.greatest(F.col("i0") + k, F.lit(0))
    last = F.least(F.col("i0") + k, F.lit(m - 1)) if lower else F.lit(m - 1).cast("long")
    return rows.where(first <= last).withColumn("i1", F.explode(F.sequence(first, last)))


def indices(spark, shape: Sequence[int]) -> DataFrame:
    """Every index row of a shape: i0, i1 …"""
    from gridloom.operators.indexing import unravel_index

    n = 1
    for s in shape:
        n *= s
    return spark.range(n).select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(unravel_index(F.col("id"), shape))])


def ediff1d(df: DataFrame, idx: str, v: str, to_begin: Sequence = (), to_end: Sequence = ()) -> DataFrame:
    """Differences of neighbours along a dense index, with values before and after them."""
    from gridloom.operators.scan import diff

    n = df.count()
    steps = diff(df.select(idx, v), v, idx, out="value").select((F.col(idx) - 1 + len(to_begin)).alias(idx), "value")
    ends = [(k, float(x)) for k, x in enumerate(to_begin)] + [(len(to_begin) + max(n - 1, 0) + k, float(x)) for k, x in enumerate(to_end)]
    return steps.unionByName(df.sparkSession.createDataFrame(ends, f"{idx} long, value double")) if ends else steps


def unique_all(df: DataFrame, v: str, idx: str) -> tuple[DataFrame, DataFrame]:
    """(value, index, count, place) of the distinct values in order, and (idx, inverse) of every element."""
    from gridloom.operators.scan import row_index

    values = row_index(df.groupBy(F.col(v).alias("value")).agg(F.min(idx).alias("index"), F.count("*").alias("count")), ["value"], "place")
    return values, df.join(values.select(F.col("value").alias(v), F.col("place").alias("inverse")), v).select(idx, "inverse")


# Shapes --------------------------------------------------------------------------------------------------------------


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    """The common shape; sizes differ only where one is 1."""
    width = max((len(s) for s in shapes), default=0)
    out = []
    for places in zip(*[(1,) * (width - len(s)) + tuple(s) for s in shapes], strict=True):
        sizes = {p for p in places if p != 1}
        if len(sizes) > 1:
            raise ValueError("shapes do not match")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


def broadcast_to(df: DataFrame, axes: Sequence[str], shape: Sequence[int], target: Sequence[int], v: str = "v") -> DataFrame:
    """Repeats the axes of size 1, and new leading axes, up to the target; the new axes are i0, i1 …"""
    if broadcast_shapes(shape, target) != tuple(target):
        raise ValueError("the target shape is too small")
    lead = len(target) - len(shape)
    out = df.select(*[F.col(a).alias(f"__{lead + k}") for k, a in enumerate(axes)], v)
    for k, n in enumerate(target):
        if k < lead or (shape[k - lead] == 1 and n != 1):
            out = out.withColumn(f"__{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else out.where("false").withColumn(f"__{k}", F.lit(0).cast("long"))
    return out.select(*[F.col(f"__{k}").alias(f"i{k}") for k in range(len(target))], v)


def broadcast_arrays(*arrays: tuple[DataFrame, Sequence[str], Sequence[int]]) -> list[DataFrame]:
    shape = broadcast_shapes(*[s for _, _, s in arrays])
    return [broadcast_to(df, axes, own, shape) for df, axes, own in arrays]


def expand_dims(df: DataFrame, axes: Sequence[str], at: int, name: str) -> tuple[DataFrame, list[str]]:
    """A new axis of size 1."""
    out = [*axes[:at], name, *axes[at:]]
    return df.withColumn(name, F.lit(0).cast("long")), out


def squeeze(df: DataFrame, axes: Sequence[str], shape: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Without the axes of size 1."""
    gone = [a for a, n in zip(axes, shape, strict=True) if n == 1]
    return df.drop(*gone), [a for a in axes if a not in gone]


def atleast_nd(df: DataFrame, axes: Sequence[str], n: int) -> tuple[DataFrame, list[str]]:
    """New axes of size 1: in front up to two dimensions, the third at the end."""
    axes = list(axes)
    while len(axes) < n:
        df, axes = expand_dims(df, axes, len(axes) if len(axes) == 2 else 0, f"__n{len(axes)}")
    return df, axes


def column_stack(parts: Sequence[DataFrame], idx: str, v: str = "v") -> DataFrame:
    """Vectors as the columns of a matrix: (i0, i1, v)."""
    out = None
    for k, p in enumerate(parts):
        part = p.select(F.col(idx).alias("i0"), F.lit(k).cast("long").alias("i1"), v)
        out = part if out is None else out.unionByName(part)
    return out


def block(parts: Sequence[Sequence[tuple[DataFrame, int, int]]], v: str = "v") -> DataFrame:
    """A matrix from rows of blocks, each (table, rows, columns)."""
    out, top = None, 0
    for line in parts:
        left = 0
        for df, _, cols in line:
            part = df.select((F.col("i0") + top).alias("i0"), (F.col("i1") + left).alias("i1"), v)
            out, left = part if out is None else out.unionByName(part), left + cols
        top += line[0][1]
    return out


def array_split(df: DataFrame, axis: str, n: int, sections: int) -> list[DataFrame]:
    """Near-equal parts; the first n % sections are one longer."""
    from gridloom.operators.shape import split

    size, extra = divmod(n, sections)
    cuts, at = [], 0
    for k in range(sections - 1):
        at += size + (k < extra)
        cuts.append(at)
    return split(df, axis, cuts)


def matrix_transpose(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    a, b = axes[-2:]
    return df.withColumn("__t", F.col(a)).withColumn(a, F.col(b)).withColumn(b, F.col("__t")).drop("__t")


def ndim_shape_size(df: DataFrame, axes: Sequence[str]) -> tuple[int, tuple[int, ...], int]:
    """Dimensions, shape (from the greatest indices) and number of cells of a dense table."""
    row = df.agg(*[(F.coalesce(F.max(a), F.lit(-1)) + 1).cast("long").alias(a) for a in axes]).first()
    size = 1
    for a in axes:
        size *= row[a]
    return len(axes), tuple(row[a] for a in axes), size


def apply_along_axis(df: DataFrame, f: Callable, axes: Sequence[str], axis: str, v: str = "v") -> DataFrame:
    """``f`` gets each line along the axis as a numpy vector, ordered by it, and gives a scalar or a vector: (other axes, idx, value).

    A line is one group in an Arrow batch; it must fit a worker.
    """
    others = [a for a in axes if a != axis]

    def run(key, rows):
        import numpy as np
        import pandas as pd

        out = np.atleast_1d(f(rows.sort_values(axis)[v].to_numpy()))
        return pd.DataFrame({**{a: [k] * len(out) for a, k in zip(others, key, strict=True)}, "idx": np.arange(len(out)), "value": out.astype(float)})

    kinds = dict(df.dtypes)
    return df.groupBy(*others).applyInPandas(run, ", ".join([*[f"{a} {kinds[a]}" for a in others], "idx long", "value double"]))


def vectorize(f: Callable, returns: str = "double") -> Callable[..., Column]:
    """A scalar Python function of one or two arguments as a column function, in Arrow batches."""

    def made(*columns: Column | str) -> Column:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        def one(a):
            return pd.Series([f(x) for x in a])

        def two(a, b):
            return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

        if len(columns) not in (1, 2):
            raise ValueError("vectorize takes functions of one or two arguments")
        run = one if len(columns) == 1 else two
        run.__annotations__ = {**{n: pd.Series for n in ("a", "b")[: len(columns)]}, "return": pd.Series}
        return pandas_udf(run, returns)(*columns)

    return made
