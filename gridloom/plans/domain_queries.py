"""Registered queries of taper windows, masked functions with domains, matrix norms and packed bits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import tapers
from gridloom.operators import bits, linalg, masked
from gridloom.plans.array_queries import _ALL, _r, _t, _whole
from gridloom.registry import query

_X = "(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 100 - 1 END)"
_HOLES = "SELECT l_returnflag, l_quantity::DOUBLE AS w, CASE WHEN l_discount > 0.02 THEN l_extendedprice::DOUBLE END AS x, CASE WHEN l_tax > 0.01 THEN l_quantity::DOUBLE END AS y FROM lineitem"


def _holes(spark, d):
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return _t(spark, d, "lineitem").select("l_returnflag", quantity.alias("w"), F.when(F.col("l_discount") > 0.02, price).alias("x"), F.when(F.col("l_tax") > 0.01, quantity).alias("y"))


@query("taper_windows", """WITH p AS (SELECT p_size, (p_size - 1) / 49.0 AS x, p_retailprice::DOUBLE AS v FROM part) SELECT p_size, round(sum(v * (0.5 - 0.5 * cos(2 * pi() * x))), 4) + 0.0 AS hanning, round(sum(v * (0.54 - 0.46 * cos(2 * pi() * x))), 4) AS hamming,
round(sum(v * (0.42 - 0.5 * cos(2 * pi() * x) + 0.08 * cos(4 * pi() * x))), 4) + 0.0 AS blackman, round(sum(v * (1 - abs(2 * x - 1))), 4) + 0.0 AS bartlett FROM p GROUP BY 1""")
def taper_windows(spark, d):
    place, price = F.col("p_size") - 1, F.col("p_retailprice").cast("double")
    kinds = {"hanning": tapers.hanning, "hamming": tapers.hamming, "blackman": tapers.blackman, "bartlett": tapers.bartlett}
    return _t(spark, d, "part").groupBy("p_size").agg(*[_r(F.sum(price * f(place, 50)), 4).alias(name) for name, f in kinds.items()])


@query("masked_domains", f"""WITH e AS (SELECT event_id, {_X} AS x FROM events) SELECT event_id, round(CASE WHEN x > 0 THEN ln(x) END, 6) + 0.0 AS log, round(CASE WHEN x > 0 THEN log10(x) END, 6) + 0.0 AS log10, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS sqrt,
round(asin(CASE WHEN abs(x) <= 1 THEN x END), 6) + 0.0 AS arcsin, round(acosh(CASE WHEN x >= 1 THEN x END), 6) AS arccosh, round(atanh(CASE WHEN abs(x) <= 1 - 1e-15 THEN x END), 6) + 0.0 AS arctanh FROM e""")
def masked_domains(spark, d):
    x = masked.masked_where(F.col("event_id") % 7 == 0, F.col("value") / 100 - 1)
    return _t(spark, d, "events").select("event_id", *[_r(masked.masked_function(f, x)).alias(f) for f in ("log", "log10", "sqrt", "arcsin", "arccosh", "arctanh")])


@query("masked_quotients", """WITH e AS (SELECT event_id, round(value)::BIGINT - 60 AS a, event_id % 5 - 2 AS b FROM events) SELECT event_id, round(CASE WHEN b <> 0 THEN a::DOUBLE / b END, 6) + 0.0 AS divide, CASE WHEN b <> 0 THEN floor(a::DOUBLE / b) END + 0.0 AS floor_divide,
CASE WHEN b <> 0 THEN (a - b * floor(a::DOUBLE / b)) END + 0.0 AS remainder, CASE WHEN b <> 0 THEN (a % b)::DOUBLE END + 0.0 AS fmod FROM e""")
def masked_quotients(spark, d):
    a, b = F.round("value").cast("long") - 60, F.col("event_id") % 5 - 2
    return _t(spark, d, "events").select("event_id", *[_r(masked.masked_divide(f, a, b)).alias(f) for f in ("divide", "floor_divide", "remainder", "fmod")])


@query("masked_moments", f"WITH h AS ({_HOLES}) SELECT l_returnflag, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, round(covar_samp(x, y), 2) AS cov, round(corr(x, y), 6) AS corr, round(sum(x * w) / sum(w) FILTER (x IS NOT NULL), 4) AS average, round(sum(w) FILTER (x IS NOT NULL), 4) AS weight FROM h GROUP BY 1")
def masked_moments(spark, d):
    holes, by = _holes(spark, d), ["l_returnflag"]
    spread = masked.cov(holes, "x", "y", by).select("l_returnflag", "n", F.round("cov", 2).alias("cov"), F.round("corr", 6).alias("corr"))
    mean = masked.average(holes, "x", "w", by).select("l_returnflag", F.round("average", 4).alias("average"), F.round("weight", 4).alias("weight"))
    return spread.join(mean, "l_returnflag")


@query("matrix_norms", f"""WITH m AS ({_ALL}), c AS (SELECT i1, sum(abs(v)) AS s FROM m GROUP BY 1), r AS (SELECT i0, sum(abs(v)) AS s FROM m GROUP BY 1) SELECT 'fro' AS kind, round(sqrt(sum(v * v)), 6) AS value FROM m
UNION ALL SELECT '1', round(max(s), 6) FROM c UNION ALL SELECT '-1', round(min(s), 6) FROM c UNION ALL SELECT 'inf', round(max(s), 6) FROM r UNION ALL SELECT '-inf', round(min(s), 6) FROM r""")
def matrix_norms(spark, d):
    m, _, _ = _whole(spark, d)
    parts = [linalg.matrix_norm(m, order).select(F.lit(str(order)).alias("kind"), F.round("value", 6).alias("value")) for order in ("fro", 1, -1, float("inf"), float("-inf"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("cross_products", "SELECT l_orderkey, l_linenumber, round((q * e - p * t)::DOUBLE, 4) + 0.0 AS c0, round((p * s - d * e)::DOUBLE, 4) + 0.0 AS c1, round((d * t - q * s)::DOUBLE, 4) + 0.0 AS c2 FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS d, l_quantity::DOUBLE AS q, l_tax::DOUBLE AS p, 2.0::DOUBLE AS s, l_tax::DOUBLE - 1 AS t, l_discount::DOUBLE + 3 AS e FROM lineitem)")
def cross_products(spark, d):
    discount, quantity, tax = (F.col(c).cast("double") for c in ("l_discount", "l_quantity", "l_tax"))
    cells = linalg.cross([discount, quantity, tax], [F.lit(2.0), tax - 1, discount + 3])
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c, 4).alias(f"c{k}") for k, c in enumerate(cells)])


@query("packed_bits", "SELECT (event_id // 8)::BIGINT AS idx, sum(CASE WHEN value > 50 THEN 1 << (7 - event_id % 8)::INT ELSE 0 END)::INT AS v, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n FROM events GROUP BY 1")
def packed_bits(spark, d):
    packed = bits.packbits(_t(spark, d, "events").withColumn("flag", F.col("value") > 50), "event_id", "flag")
    counts = bits.unpackbits(packed).groupBy(F.expr("idx div 8").alias("idx")).agg(F.sum("flag").alias("n"))
    return packed.join(counts, "idx")
