"""Running and neighbourhood operators along an ordered index.

A running aggregate over a whole array never sorts it in one task: the index is cut into ranges at bounds that are drawn
once and are part of the plan, each range is folded on its own, and the totals of the ranges before it (one
row each) are added.  A row's range is a function of its index alone, so both passes agree on it, however Spark
partitions either of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index values drawn for each range; the bounds are quantiles of them.
DRAWN = 40
#: Bounds searched by compiled comparisons; only the steps between them are interpreted.
COMPILED = 64


def _frame(by: Sequence[str], idx: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*idx)


def bounds(df: DataFrame, idx: Sequence[str], ranges: int) -> list:
    """At most ``ranges`` - 1 rising index rows that cut the table into ranges of about equal size, from a bounded sample."""
    sample = df.select(*idx).orderBy(F.rand(17)).limit(DRAWN * ranges)
    rows = sample.orderBy(*idx).collect()
    cuts = [rows[len(rows) * k // ranges] for k in range(1, ranges)] if rows else []
    return [r for i, r in enumerate(cuts) if not i or r != cuts[i - 1]]


def partitioned(df: DataFrame, idx: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range of the index as ``__p``, by binary search over literal bounds (nested comparisons)."""
    idx = list(idx)
    cuts = bounds(df, idx, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not cuts:
        return df.withColumn("__p", F.lit(0))
    kinds = {f.name: f.dataType for f in df.select(*idx).schema}
    points = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in idx]) for r in cuts]
    top = [len(cuts) * k // COMPILED for k in range(COMPILED)] if len(cuts) > COMPILED else range(len(cuts))

    def narrowed(key: Column, leaf, lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(points[top[mid]] <= key, narrowed(key, leaf, mid + 1, hi)).otherwise(narrowed(key, leaf, lo, mid))

    def search(key: Column) -> Column:
        if len(top) == len(cuts):
            return narrowed(key, F.lit, 0, len(cuts))
        span = lambda k: F.struct(F.lit(top[k - 1] + 1 if k else 0).alias("lo"), F.lit(top[k] if k < len(top) else len(cuts)).alias("hi"))
        steps = F.sequence(F.lit(1), F.lit((len(cuts) // COMPILED + 1).bit_length()))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            above = F.get(F.array(*points), mid) <= key
            done = acc["lo"] >= acc["hi"]
            return F.struct(F.when(~done & above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(done | above, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(steps, narrowed(key, span, 0, len(top)), halve, lambda acc: acc["lo"])

    return df.withColumn("__p", search(F.struct(*[F.col(c) for c in idx])))


def cumulative(df: DataFrame, v: str, idx: Sequence[str] | str, out: str = "value", by: Sequence[str] = (), kind: str = "sum") -> DataFrame:
    """Running sum, prod, min or max; grouped when ``by`` is given, else in two passes over ranges."""
    idx = [idx] if isinstance(idx, str) else list(idx)
    f = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[kind]
    if by:
        return df.withColumn(out, f(v).over(_frame(by, idx).rowsBetween(Window.unboundedPreceding, 0)))
    parts = partitioned(df, idx)
    totals = parts.groupBy("__p").agg(f(v).alias("__t"))
    before = totals.select("__p", f("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    local = parts.withColumn(out, f(v).over(_frame(["__p"], idx).rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(F.broadcast(before), "__p")  # a row a range
    merge = {"sum": lambda a, b: F.coalesce(b, F.lit(0)) + a, "prod": lambda a, b: F.coalesce(b, F.lit(1.0)) * a, "min": F.least, "max": F.greatest}[kind]
    return joined.withColumn(out, merge(F.col(out), F.col("__b"))).drop("__p", "__b")


def nancumsum(df: DataFrame, v: str, idx, out: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return cumulative(df.withColumn("__v", F.nanvl(F.col(v).cast("double"), F.lit(0.0))), "__v", idx, out, by).drop("__v")


def nancumprod(df: DataFrame, v: str, idx, out: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return cumulative(df.withColumn("__v", F.nanvl(F.col(v).cast("double"), F.lit(1.0))), "__v", idx, out, by, "prod").drop("__v")


def cumulative_sum(df: DataFrame, v: str, idx: str, include_initial: bool = False) -> DataFrame:
    out = cumulative(df.select(idx, v), v, idx).select((F.col(idx) + (1 if include_initial else 0)).alias(idx), "value")
    return out.unionByName(df.sparkSession.range(1).select(F.lit(0).alias(idx), F.lit(0).alias("value"))) if include_initial else out


def row_index(df: DataFrame, idx: Sequence[str], out: str = "idx") -> DataFrame:
    """A dense position 0, 1, 2 … in the order of the columns, in two passes."""
    parts = partitioned(df, idx)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    ranked = parts.withColumn("__r", F.row_number().over(_frame(["__p"], idx)))
    return ranked.join(F.broadcast(before), "__p").withColumn(out, F.col("__r") - 1 + F.col("__b")).drop("__p", "__b", "__r")


def shifted(df: DataFrame, idx: str, columns: Sequence[str], by: int, suffix: str = "_prev") -> DataFrame:
    """Each row beside the one ``by`` positions before, as an equi join on a dense index (no global window)."""
    other = df.select((F.col(idx) + by).alias(idx), *[F.col(c).alias(c + suffix) for c in columns])
    return df.join(other, idx, "left")


def diff(df: DataFrame, v: str, idx: str, n: int = 1, by: Sequence[str] = (), out: str = "value") -> DataFrame:
    """n-th difference; the first n places of each line drop out.  Without groups ``idx`` must be dense."""
    cur = df.withColumn(out, F.col(v))
    for _ in range(n):
        if by:
            cur = cur.withColumn(out, F.col(out) - F.lag(out).over(_frame(by, [idx])))
        else:
            cur = shifted(cur, idx, [out], 1).withColumn(out, F.col(out) - F.col(out + "_prev")).drop(out + "_prev")
        cur = cur.where(F.col(out).isNotNull())
    return cur


def gradient(df: DataFrame, v: str, idx: str, by: Sequence[str], h: float = 1.0, out: str = "value") -> DataFrame:
    """Central differences inside, one-sided at the ends of each line."""
    w = _frame(by, [idx])
    nxt, prv, x = F.lead(v).over(w), F.lag(v).over(w), F.col(v)
    return df.withColumn(out, F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) / (2 * h)).when(nxt.isNotNull(), (nxt - x) / h).when(prv.isNotNull(), (x - prv) / h))


def unwrap(df: DataFrame, v: str, idx: str, by: Sequence[str], period: float, out: str = "value", keep_half: bool = True) -> DataFrame:
    """Jumps of half a period and more are folded back; one that folds to exactly half a period stays upward if it was, or always falls if not ``keep_half``."""
    w = _frame(by, [idx])
    d = F.col(v) - F.lag(v).over(w)
    half = period / 2
    wrapped = d + half - F.floor((d + half) / period) * period - half
    wrapped = F.when((wrapped == -half) & (d > 0), half).otherwise(wrapped) if keep_half else wrapped
    fix = F.when(F.abs(d) < half, 0.0).otherwise(wrapped - d)
    return df.withColumn("__f", F.coalesce(fix, F.lit(0.0))).withColumn(out, F.col(v) + F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def roll(df: DataFrame, idx: str, shift: int, n: int) -> DataFrame:
    return df.withColumn(idx, F.pmod(F.col(idx) + shift, F.lit(n)))


def sliding(df: DataFrame, v: str, idx: str, width: int, by: Sequence[str], out: str = "window") -> DataFrame:
    """Every full window of ``width`` values as an array, at the index of its first."""
    w = _frame(by, [idx]).rowsBetween(0, width - 1)
    return df.withColumn(out, F.collect_list(v).over(w)).where(F.size(out) == width)


def moving_average(df: DataFrame, v: str, idx: Sequence[str], width: int, by: Sequence[str], out: str = "value") -> DataFrame:
    return df.withColumn(out, F.avg(v).over(_frame(by, list(idx)).rowsBetween(1 - width, 0)))


def convolve(df: DataFrame, v: str, idx: str, kernel: Sequence[float], mode: str = "full", n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Discrete convolution with a short kernel: every element is sent to the places it adds to, then summed."""
    m = len(kernel)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(c)).alias("c")) for k, c in enumerate(kernel)])
    spread = df.select(*by, F.col(idx), F.col(v), F.explode(taps).alias("t"))
    full = spread.groupBy(*by, (F.col(idx) + F.col("t.k")).alias(idx)).agg(F.sum(F.col(v) * F.col("t.c")).alias("value"))
    if mode == "full":
        return full
    if n is None:
        raise ValueError("modes same and valid need the length n")
    lo, length = ((m - 1) // 2, max(n, m)) if mode == "same" else (min(n, m) - 1, max(n, m) - min(n, m) + 1)
    return full.where((F.col(idx) >= lo) & (F.col(idx) < lo + length)).withColumn(idx, F.col(idx) - lo)


def correlate(df: DataFrame, v: str, idx: str, kernel: Sequence[float], mode: str = "valid", n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return convolve(df, v, idx, list(reversed(kernel)), mode, n, by)


def interp(x: Column, xp: Sequence[float], fp: Sequence[float], left: float | None = None, right: float | None = None) -> Column:
    """Piecewise linear through literal points, as a binary search in expressions."""

    def piece(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            slope = (fp[hi] - fp[lo]) / (xp[hi] - xp[lo])
            return F.lit(float(fp[lo])) + (x - float(xp[lo])) * slope
        mid = (lo + hi) // 2
        return F.when(x < float(xp[mid]), piece(lo, mid)).otherwise(piece(mid, hi))

    ends = F.when(x < float(xp[0]), float(fp[0] if left is None else left)).when(x > float(xp[-1]), float(fp[-1] if right is None else right)).when(x == float(xp[-1]), float(fp[-1]))
    return ends.otherwise(piece(0, len(xp) - 1) if len(xp) > 1 else F.lit(float(fp[0])))


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row at or before it, in one sort per group (union and last value)."""
    names = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*names).alias("__l"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__r"))
    b = right.select(*by, on, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*columns).alias("__r"))
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*by, on, "__l.*", *[F.col("__r")[c].alias(c) for c in columns])
