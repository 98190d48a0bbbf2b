"""Reductions over long-form arrays: one row per element, ``by`` names the axes that stay.

All are grouped aggregations with partial sums before the shuffle; exact order statistics use Spark's exact
percentile where its definition fits, else ranks inside each group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scan import partitioned

NAN = float("nan")


def _col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _number(v: Column) -> Column:
    """NaN becomes NULL, which aggregates pass over."""
    return F.when(~F.isnan(v.cast("double")), v)


def total(v, initial=0) -> Column:
    return F.coalesce(F.sum(_col(v)), F.lit(0)) + initial


def product(v) -> Column:
    return F.coalesce(F.product(_col(v)), F.lit(1.0))


def _present(x: Column, *fields: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(*fields))


def amin(v) -> Column:
    """NaN if there is one; the element's own type otherwise, so that whole numbers stay exact."""
    x = _col(v)
    return F.min(_present(x, (~F.isnan(x.cast("double"))).alias("n"), x.alias("v")))["v"]


def amax(v) -> Column:
    """NaN if there is one (it is the greatest value in Spark's order); the element's own type."""
    return F.max(_col(v))


def argmin(v, idx) -> Column:
    """Index of the first NaN, else of the first least value."""
    x = _col(v)
    return F.min(_present(x, (~F.isnan(x.cast("double"))).alias("n"), x.alias("v"), _col(idx).alias("i")))["i"]


def argmax(v, idx) -> Column:
    x = _col(v)
    return -F.max(_present(x, x.alias("v"), (-_col(idx)).alias("i")))["i"]


def nanargmin(v, idx) -> Column:
    x = _col(v)
    return F.min(F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), _col(idx).alias("i"))))["i"]


def nanargmax(v, idx) -> Column:
    x = _col(v)
    return -F.max(F.when(~F.isnan(x.cast("double")), F.struct(x.alias("v"), (-_col(idx)).alias("i"))))["i"]


def mean(v) -> Column:
    return F.avg(_col(v))


def var(v, ddof: int = 0) -> Column:
    x = _col(v).cast("double")
    if ddof == 0:
        return F.var_pop(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.nullif(n - ddof, F.lit(0))).otherwise(NAN)


def std(v, ddof: int = 0) -> Column:
    return F.sqrt(var(v, ddof))


def ptp(v) -> Column:
    return amax(v) - amin(v)


def all_(v) -> Column:
    return F.coalesce(F.bool_and(_col(v) != 0), F.lit(True))


def any_(v) -> Column:
    return F.coalesce(F.bool_or(_col(v) != 0), F.lit(False))


def count_nonzero(v) -> Column:
    return F.count_if(_col(v) != 0)


def average(v, w) -> Column:
    return F.sum(_col(v) * _col(w)) / F.sum(_col(w))


def nansum(v) -> Column:
    return total(_number(_col(v)))


def nanprod(v) -> Column:
    return product(_number(_col(v)))


def nanmean(v) -> Column:
    return F.avg(_number(_col(v)))


def nanmin(v) -> Column:
    return F.min(_number(_col(v)))


def nanmax(v) -> Column:
    return F.max(_number(_col(v)))


def nanvar(v, ddof: int = 0) -> Column:
    return var(_number(_col(v)), ddof)


def nanstd(v, ddof: int = 0) -> Column:
    return F.sqrt(nanvar(v, ddof))


def median(v) -> Column:
    x = _col(v).cast("double")
    return F.when(F.bool_or(F.isnan(x)), NAN).otherwise(F.percentile(x, F.lit(0.5)))


def nanmedian(v) -> Column:
    return F.percentile(_number(_col(v)).cast("double"), F.lit(0.5))


def percentile(v, q: float) -> Column:
    """Linear interpolation, the default method; NaN if there is one."""
    x = _col(v).cast("double")
    return F.when(F.bool_or(F.isnan(x)), NAN).otherwise(F.percentile(x, F.lit(q / 100)))


def percentiles(v, qs: Sequence[float]) -> Column:
    """Several of them as an array, from one buffer of counted values."""
    x = _col(v).cast("double")
    spoiled = F.array(*[F.lit(NAN) for _ in qs])
    return F.when(F.bool_or(F.isnan(x)), spoiled).otherwise(F.percentile(x, F.array(*[F.lit(q / 100) for q in qs])))


def nanpercentile(v, q: float) -> Column:
    return F.percentile(_number(_col(v)).cast("double"), F.lit(q / 100))


#: Continuous methods by (alpha, beta): the virtual index is n q + alpha + q (1 - alpha - beta) - 1.
CONTINUOUS = {"interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "linear": (1.0, 1.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}
METHODS = (*CONTINUOUS, "inverted_cdf", "averaged_inverted_cdf", "closest_observation", "lower", "higher", "midpoint", "nearest")


def _virtual(n: Column, q: float, method: str) -> tuple[Column, Column]:
    """The lower index and the share of the upper neighbour."""
    if method in CONTINUOUS:
        alpha, beta = CONTINUOUS[method]
        h = n * q + (alpha + q * (1 - alpha - beta)) - 1
        return F.floor(h), h - F.floor(h)
    inner = (n - 1) * q
    if method in ("lower", "higher", "nearest"):
        pick = {"lower": F.floor, "higher": F.ceil, "nearest": lambda x: F.rint(x).cast("long")}[method](inner)
        return pick, F.lit(0.0)
    if method == "midpoint":
        return F.floor(inner), F.when(inner == F.floor(inner), 0.0).otherwise(0.5)
    h = n * q - (1.5 if method == "closest_observation" else 1)
    whole = h == F.floor(h)
    if method == "inverted_cdf":
        return F.floor(h), F.when(whole, 0.0).otherwise(1.0)
    if method == "averaged_inverted_cdf":
        return F.floor(h), F.when(whole, 0.5).otherwise(1.0)
    if method == "closest_observation":
        return F.floor(h), F.when(whole & (F.floor(h) % 2 != 0), 0.0).otherwise(1.0)
    raise ValueError(f"unknown method {method}")


def quantile(df: DataFrame, v: str, qs: Sequence[float], by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Rows (by…, q, value); NaN for a group that holds one.

    Values are counted first.  The distinct values of all groups are cut into ranges; a value's rank in its group is a running
    count inside its range, more by what the group has in the ranges before (one row for each range of a group).
    So neither a large group nor a whole table is sorted in one task, and the counts are shuffled once.
    """
    by = list(by)
    counts = df.where(F.col(v).isNotNull()).groupBy(*by, F.col(v).cast("double").alias("__v")).agg(F.count("*").alias("__k"))
    # the key is a struct, in which nulls are equal: groups with a null key are groups too
    parts = partitioned(counts, [*by, "__v"]).select(F.struct(*by, "__p").alias("__key"), "__v", "__k")
    totals = parts.groupBy("__key").agg(F.sum("__k").alias("__t"), F.max(F.isnan("__v")).alias("__nan"))
    # merged by key, as the window needs them; by estimates Spark would broadcast the counted values
    group = Window.partitionBy(*[F.col("__key")[c] for c in by])
    earlier = group.orderBy(F.col("__key")["__p"]).rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.select("__key", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__s"), F.sum("__t").over(group).alias("__n"), F.max("__nan").over(group).alias("__nan"))
    inner = Window.partitionBy("__key").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.join(groups.hint("merge"), "__key").withColumn("__hi", F.col("__s") + F.sum("__k").over(inner)).withColumn("__lo", F.col("__hi") - F.col("__k"))
    last, wanted, here = F.col("__n") - 1, [], F.lit(False)
    inside = lambda i: (i >= F.col("__lo")) & (i < F.col("__hi"))
    for q in qs:
        low, share = _virtual(F.col("__n"), float(q), method)
        a, b = (F.greatest(F.least(i, last), F.lit(0)).cast("long") for i in (low, low + 1))
        wanted.append(F.struct(F.lit(float(q)).alias("q"), a.alias("a"), b.alias("b"), share.cast("double").alias("g")))
        here = here | inside(a) | inside(b)
    found = ranked.where(here).withColumn("__w", F.explode(F.array(*wanted)))
    at = lambda i: F.max(F.when(inside(F.col("__w")[i]), F.col("__v")))
    picked = found.where(inside(F.col("__w.a")) | inside(F.col("__w.b"))).select(*[F.col("__key")[c].alias(c) for c in by], F.col("__w.q").alias("q"), "__w", "__v", "__lo", "__hi", "__nan")
    picked = picked.groupBy(*by, "q").agg(at("a").alias("__x"), at("b").alias("__y"), F.first("__w.g").alias("__g"), F.first("__nan").alias("__nan"))
    value = F.when(F.col("__nan"), NAN).otherwise(F.col("__x") + F.col("__g") * (F.col("__y") - F.col("__x")))
    return picked.select(*by, "q", value.alias("value"))


def histogram_bin_edges(df: DataFrame, v: str, bins: int | str = 10, limits: tuple[float, float] | None = None) -> list[float]:
    x = F.col(v).cast("double")
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("g")).first()
    middle = {r.q: r.value for r in quantile(df, v, [0.25, 0.75]).collect()} if bins in ("auto", "fd") else {}
    lo, hi = limits or (s.lo, s.hi) if s.n else (0.0, 1.0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if isinstance(bins, str):
        n, span = max(s.n, 1), hi - lo
        width = {
            "sqrt": span / math.sqrt(n), "sturges": span / (math.log2(n) + 1), "rice": span / (2 * n ** (1 / 3)), "scott": (24 * math.sqrt(math.pi) / n) ** (1 / 3) * (s.sd or 0),
            "fd": 2 * (middle.get(0.75, 0) - middle.get(0.25, 0)) * n ** (-1 / 3),
            "doane": span / (1 + math.log2(n) + math.log2(1 + abs(s.g or 0) / math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) if n > 2 and s.sd else 0,
        }
        h = min(max(width["fd"], width["sqrt"] / 2) or width["sturges"], width["sturges"]) if bins == "auto" else width[bins]
        bins = max(int(math.ceil(span / h)), 1) if h else 1
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def bin_of(v: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bin, the last one closed; NULL outside.  A binary search over literal edges."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < float(edges[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return F.when((v >= float(edges[0])) & (v <= float(edges[-1])), search(0, len(edges) - 1))


def histogram(df: DataFrame, v: str, edges: Sequence[float], weights: str | None = None, density: bool = False) -> DataFrame:
    """Rows (bin, low, high, value) for every bin, empty ones too."""
    spark = df.sparkSession
    amount = F.sum(weights) if weights else F.count("*")
    found = df.select(bin_of(F.col(v), edges).alias("bin"), *([weights] if weights else [])).where("bin is not null").groupBy("bin").agg(amount.alias("value"))
    frame = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, low double, high double")
    out = frame.join(found, "bin", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    if density:
        all_ = out.agg(F.sum("value").alias("__t"))
        out = out.crossJoin(all_).withColumn("value", F.col("value") / F.col("__t") / (F.col("high") - F.col("low"))).drop("__t")
    return out


def histogramdd(df: DataFrame, columns: dict[str, Sequence[float]], weights: str | None = None) -> DataFrame:
    """Filled cells only: rows (bin_<column>…, value)."""
    bins = [bin_of(F.col(c), e).alias(f"bin_{c}") for c, e in columns.items()]
    names = [f"bin_{c}" for c in columns]
    rows = df.select(*bins, *([weights] if weights else [])).dropna(subset=names)
    return rows.groupBy(*names).agg((F.sum(weights) if weights else F.count("*")).alias("value"))


def digitize(v: Column, edges: Sequence[float], right: bool = False) -> Column:
    """How many edges lie at or below the value (below, with ``right``), by binary search; falling edges count from the other end."""
    if len(edges) > 1 and edges[0] > edges[-1]:
        return F.lit(len(edges)) - digitize(v, list(reversed(edges)), right)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        past = (v > float(edges[mid])) if right else (v >= float(edges[mid]))
        return F.when(past, search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(v.isNotNull(), search(0, len(edges)))


def bincount(df: DataFrame, v: str, weights: str | None = None, minlength: int = 0) -> DataFrame:
    """Rows (bin, value) for 0 … max."""
    counts = df.groupBy(F.col(v).cast("long").alias("bin")).agg((F.sum(weights) if weights else F.count("*")).alias("value"))
    top = counts.agg(F.max("bin")).first()[0]
    n = max(minlength, 0 if top is None else top + 1)
    return df.sparkSession.range(n).select(F.col("id").alias("bin")).join(counts, "bin", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def cov(df: DataFrame, columns: Sequence[str], ddof: int = 1, corr: bool = False) -> DataFrame:
    """Rows (i, j, value) from one pass over the data."""
    pairs = [(a, b) for a in columns for b in columns]
    f = F.corr if corr else (F.covar_samp if ddof == 1 else F.covar_pop)
    wide = df.agg(*[f(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"x{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"x{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def corrcoef(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cov(df, columns, corr=True)


def trapezoid(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Composite trapezoidal rule along x; the steps stay inside each group."""
    order = Window.partitionBy(*by).orderBy(x)
    step = (F.col(y) + F.lag(y).over(order)) / 2 * (F.col(x) - F.lag(x).over(order))
    return df.withColumn("__s", step).groupBy(*by).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("value"))


def reduceat(df: DataFrame, v: str, idx: str, starts: Sequence[int], f=F.sum, stop: int | None = None) -> DataFrame:
    """Segment k covers [starts[k], starts[k+1]); a segment that doesn't rise is its first element alone.  The last one ends before ``stop``, or with the array."""
    n = len(starts)
    spans = [(k, s, (starts[k + 1] if k + 1 < n and starts[k + 1] > s else (stop if k + 1 == n else s + 1))) for k, s in enumerate(starts)]
    segments = df.sparkSession.createDataFrame(spans, "segment int, lo long, hi long")
    joined = df.join(F.broadcast(segments), (F.col(idx) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(idx) < F.col("hi"))))
    return joined.groupBy("segment").agg(f(v).alias("value"))


def scatter_at(target: DataFrame, updates: DataFrame, idx: str, v: str, f=F.sum) -> DataFrame:
    """Unbuffered ``at``: all updates of an index apply, also repeated ones."""
    sums = updates.groupBy(idx).agg(f(v).alias("__u"))
    return target.join(sums, idx, "left").withColumn(v, F.col(v) + F.coalesce("__u", F.lit(0))).drop("__u")


def allclose(df: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    from gridloom.functions.ufuncs import isclose

    return df.agg(F.coalesce(F.bool_and(isclose(F.col(a), F.col(b), rtol, atol)), F.lit(True)).alias("value"))


def array_equal(a: DataFrame, b: DataFrame, idx: str, v: str, equal_nan: bool = False) -> DataFrame:
    both = a.select(idx, F.col(v).alias("__l"), F.lit(1).alias("__a")).join(b.select(idx, F.col(v).alias("__r"), F.lit(1).alias("__b")), idx, "full")
    same = F.col("__l").eqNullSafe(F.col("__r")) & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    if not equal_nan:
        same = same & ~F.isnan(F.col("__l").cast("double"))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("value"))
