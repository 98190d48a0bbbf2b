"""Registered queries of the axis-wise operators, shapes and series, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import axes, series
from gridloom.plans.array_queries import _ALL, _DIMS, _N, _r, _t, _whole
from gridloom.registry import query


@query("axis_reductions", f"""WITH m AS ({_ALL}) SELECT 'i0' AS axis, i1 AS k, round(sum(CASE WHEN v > 0 THEN v END) + 10, 4) AS total, max(v) AS hi, min(v) AS lo, round(stddev_pop(v), 4) AS std, count(*) FILTER (v <> 0) AS nonzero, bool_and(v <> 0) AS every, round(median(v), 5) AS median FROM m GROUP BY i1
UNION ALL SELECT 'i1', i0, round(sum(CASE WHEN v > 0 THEN v END) + 10, 4), max(v), min(v), round(stddev_pop(v), 4), count(*) FILTER (v <> 0), bool_and(v <> 0), round(median(v), 5) FROM m GROUP BY i0""")
def axis_reductions(spark, d):
    m, _, _ = _whole(spark, d)
    out = None
    for axis, other in (("i0", "i1"), ("i1", "i0")):
        cut = lambda name, **o: axes.reduce_axes(m, name, "v", ["i0", "i1"], axis, **o)  # noqa: B023, E731
        part = cut("sum", where=F.col("v") > 0, initial=10.0).select(F.col(other).alias("k"), F.round("v", 4).alias("total"))
        for name, reduction, digits in (("hi", "max", None), ("lo", "min", None), ("std", "std", 4), ("nonzero", "count_nonzero", None), ("every", "all", None), ("median", "median", 5)):
            value = F.col("v") if digits is None else F.round("v", digits)
            part = part.join(cut(reduction).select(F.col(other).alias("k"), value.alias(name)), "k")
        part = part.withColumn("axis", F.lit(axis))
        out = part if out is None else out.unionByName(part)
    return out


@query("axis_places", f"WITH m AS ({_ALL}), g AS (SELECT i0, max(v) AS hi, min(v) AS lo FROM m GROUP BY 1) SELECT i0, min(CASE WHEN v = hi THEN i1 END)::BIGINT AS argmax, min(CASE WHEN v = lo THEN i1 END)::BIGINT AS argmin FROM m JOIN g USING (i0) GROUP BY 1")
def axis_places(spark, d):
    m, _, _ = _whole(spark, d)
    top, low = (axes.place_along(m, n, "v", ["i0", "i1"], "i1").withColumnRenamed("place", n) for n in ("argmax", "argmin"))
    return top.join(low, "i0")


@query("axis_take_along", f"WITH m AS ({_ALL}) SELECT a.i0, a.i1::BIGINT AS i1, round(b.v, 6) AS v FROM m a JOIN m b ON b.i0 = a.i0 AND b.i1 = (a.i1 * 5 + a.i0) % {_DIMS}")
def axis_take_along(spark, d):
    m, _, cols = _whole(spark, d)
    picks = m.select("i0", "i1", ((F.col("i1") * 5 + F.col("i0")) % cols - F.when(F.col("i1") % 2 == 0, cols).otherwise(0)).alias("pick"))
    return axes.take_along_axis(m, picks, ["i0", "i1"], "i1", n=cols).withColumn("v", F.round("v", 6))


@query("axis_argwhere", f"SELECT i0, i1::BIGINT AS i1, (i0 * {_DIMS} + i1)::BIGINT AS idx FROM ({_ALL}) WHERE v > 0.1")
def axis_argwhere(spark, d):
    m, rows, cols = _whole(spark, d)
    hot = m.withColumn("v", (F.col("v") > 0.1).cast("int"))
    flat = axes.flatnonzero(hot, "v", ["i0", "i1"], (rows, cols))
    return axes.argwhere(hot, "v", ["i0", "i1"]).withColumn("idx", F.col("i0") * cols + F.col("i1")).join(flat, "idx", "left_semi")


@query("axis_ediff1d", "SELECT (row_number() OVER (ORDER BY event_id))::BIGINT AS i, round(lead(value) OVER (ORDER BY event_id) - value, 6) + 0.0 AS value FROM events QUALIFY lead(value) OVER (ORDER BY event_id) IS NOT NULL UNION ALL SELECT 0, -1.0 UNION ALL SELECT (SELECT count(*) FROM events), 9.0")
def axis_ediff1d(spark, d):
    from gridloom.operators.scan import row_index

    rows = row_index(_t(spark, d, "events").select("event_id", F.col("value").alias("v")), ["event_id"], "i")
    return axes.ediff1d(rows, "i", "v", [-1.0], [9.0]).select(F.col("i").cast("long").alias("i"), _r(F.col("value")).alias("value"))


@query("unique_all_places", "WITH u AS (SELECT p_size AS value, min(p_partkey) AS first, count(*) AS n, (row_number() OVER (ORDER BY p_size) - 1)::BIGINT AS place FROM part GROUP BY 1) SELECT p_partkey, place AS inverse, first, n FROM part JOIN u ON p_size = value")
def unique_all_places(spark, d):
    values, inverse = axes.unique_all(_t(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")
    named = values.select(F.col("place").alias("inverse"), F.col("index").alias("first"), F.col("count").alias("n"))
    return inverse.join(named, "inverse").withColumn("inverse", F.col("inverse").cast("long"))


@query("broadcast_outer", "SELECT r_regionkey::BIGINT AS i0, n_nationkey::BIGINT AS i1, (r_regionkey * 100 + n_nationkey)::BIGINT AS v FROM region, nation")
def broadcast_outer(spark, d):
    r = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("a"), (F.col("r_regionkey") * 100).cast("long").alias("v")).withColumn("b", F.lit(0).cast("long"))
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("v"))
    sizes = r.count(), n.count()
    left, right = axes.broadcast_arrays((r, ["a", "b"], (sizes[0], 1)), (n, ["a"], (sizes[1],)))
    return left.join(right.withColumnRenamed("v", "w"), ["i0", "i1"]).select("i0", "i1", (F.col("v") + F.col("w")).alias("v"))


@query("triangle_sums", f"SELECT i0, count(*) AS n, sum(i1)::BIGINT AS s FROM (SELECT range AS i0, unnest(range(0, range + 1)) AS i1 FROM range(0, {_N})) GROUP BY 1")
def triangle_sums(spark, d):
    n = _t(spark, d, "embeddings").count()
    return axes.triangle(spark, n).groupBy("i0").agg(F.count("*").alias("n"), F.sum("i1").alias("s"))


@query("series_products", "SELECT event_id, round(p * q, 5) + 0.0 AS product, round(p, 5) + 0.0 AS quotient, round(2 + 12 * x, 5) AS slope FROM (SELECT event_id, x, 1 + 2 * x + 3 * (2 * x * x - 1) AS p, 2 - x AS q FROM (SELECT event_id, value / 701 AS x FROM events))")
def series_products(spark, d):
    x = F.col("value") / 701
    p, q = [1, 2, 3], [2, -1]
    product = series.mul(p, q, "chebyshev")
    quotient, _ = series.divide(product, q, "chebyshev")
    made = {"product": series.value(product, x, "chebyshev"), "quotient": series.value(quotient, x, "chebyshev"), "slope": series.value(series.derivative(p, 1, "chebyshev"), x, "chebyshev")}
    return _t(spark, d, "events").select("event_id", *[_r(c, 5).alias(n) for n, c in made.items()])


@query("series_quadrature", "SELECT * FROM (VALUES ('legendre', 0.4), ('hermite', 0.75 * sqrt(pi())), ('hermite_e', 3 * sqrt(2 * pi())), ('laguerre', 24.0), ('chebyshev', 0.375 * pi())) t(kind, raw)".replace("SELECT *", "SELECT kind, round(raw::DOUBLE, 8) AS value"))
def series_quadrature(spark, d):
    """The integral of x ** 4 against each basis's weight, by four nodes."""
    rows = [(kind, float((w * x**4).sum())) for kind in series.KINDS[1:] for x, w in [series.gauss(4, kind)]]
    return spark.createDataFrame(rows, "kind string, value double").withColumn("value", F.round("value", 8))
