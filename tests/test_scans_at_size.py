"""Running operators on 3,000,000 rows with wide payload and many partitions: every row is compared."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import indexing, ordering, records, reduce, scan

N = 3_000_000


@pytest.fixture(scope="module")
def wide(spark):
    """i in a shuffled order; the payload makes the two passes read different columns."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    i = F.pmod(F.col("id") * 1_000_003, F.lit(N))
    yield spark.range(N).select(i.alias("i"), (i % 7 + 1).alias("v"), F.repeat(F.lit("x"), 40).alias("pad"), F.rand(3).alias("noise"))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wrong(df, have, want):
    return df.where(~F.col(have).eqNullSafe(want)).count()


def test_running_sum_and_extremes(wide):
    out = scan.cumulative(wide, "v", "i", "s").select("i", "v", "s", "pad")
    whole = F.floor(F.col("i") / 7)
    assert wrong(out, "s", whole * 28 + (F.col("i") % 7 + 1) * (F.col("i") % 7 + 2) / 2) == 0 and out.count() == N
    low = scan.cumulative(wide.withColumn("w", -F.col("i")), "w", "i", "m", kind="min").select("i", "m", "pad")
    assert wrong(low, "m", -F.col("i")) == 0
    high = scan.cumulative(wide, "i", "i", "m", kind="max").select("i", "m", "noise")
    assert wrong(high, "m", F.col("i")) == 0
    sign = scan.cumulative(wide.withColumn("w", F.when(F.col("v") == 7, -1.0).otherwise(1.0)), "w", "i", "p", kind="prod").select("i", "p", "pad")
    assert wrong(sign, "p", F.when(F.floor((F.col("i") + 1) / 7) % 2 == 1, -1.0).otherwise(1.0)) == 0


def test_dense_positions(wide):
    assert wrong(scan.row_index(wide, ["i"], "at").select("i", "at", "pad", "noise"), "at", F.col("i")) == 0
    ranks = ordering.argsort(wide, "v", "i").select("v", "i", "rank", "pad")
    per = {r.v: r.n for r in wide.groupBy("v").agg(F.count("*").alias("n")).collect()}
    start = {v: sum(n for w, n in per.items() if w < v) for v in per}
    starts = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    assert wrong(ranks, "rank", starts[F.col("v")] + F.floor(F.col("i") / 7)) == 0
    assert wrong(ordering.lexsort(wide, ["i"], "i").select("i", "rank", "pad"), "rank", F.col("i")) == 0
    gone = wide.where("i % 2 = 0").select("i")
    assert wrong(indexing.delete(wide.withColumn("old", F.col("i")), "i", gone).select("i", "old", "pad"), "i", F.floor(F.col("old") / 2)) == 0


def test_positional_merge(spark, wide):
    right = spark.range(N).select((F.col("id") * 2).alias("k"))
    both = records.merge_arrays(wide.select("i"), right, (["i"], ["k"]), {})
    assert wrong(both, "k", F.col("i") * 2) == 0 and both.count() == N


def test_quantiles_without_a_group(wide):
    got = {r.q: r.value for r in reduce.quantile(wide, "i", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.25: (N - 1) / 4, 0.5: (N - 1) / 2, 1.0: N - 1.0}


def test_odd_values(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 3.0), (None, 2.0), (None, 4.0), ("b", None)], "g string, x double")
    got = {(r.g, r.q): r.value for r in reduce.quantile(rows, "x", [0.0, 0.5], ["g"]).collect()}
    assert got[None, 0.5] == 3.0 and str(got["a", 0.0]) == "nan" and ("b", 0.5) not in got
    one = rows.where("g = 'a'").agg(reduce.percentile("x", 50).alias("p"), reduce.percentiles("x", [50]).alias("ps")).first()
    assert str(one.p) == "nan" and str(one.ps[0]) == "nan"
    assert scan.cumulative(rows.where("false"), "x", "x", "s").count() == 0
    keys = spark.createDataFrame([(None, 1), (nan, 1), (-1.0, 1), (5.0, 1), (None, 1)], "k double, one int")
    assert [r.at for r in scan.row_index(keys, ["k"], "at").orderBy("at").collect()] == list(range(5))
    big = spark.createDataFrame([(-(2**62) - 1, 3), (2**62 + 1, -5), (-7, 2), (9, 0), (2**53 + 1, 1)], "a long, b long")
    from gridloom.functions import ufuncs

    got = [(r.q, r.a, r.b) for r in big.select("a", "b", ufuncs.ufunc("floor_divide", F.col("a"), F.col("b")).alias("q")).collect()]
    assert all(q == (a // b if b else 0) for q, a, b in got)


@pytest.mark.parametrize("right", [False, True])
def test_digitize(spark, right):
    import numpy as np

    edges = [0.0, 1.0, 2.5, 4.0, 10.0]
    xs = [-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 10.0, 11.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    for e in (edges, edges[::-1]):
        got = [r.d for r in rows.select(reduce.digitize(F.col("x"), e, right).alias("d")).collect()]
        assert got == np.digitize(xs, e, right).tolist()
