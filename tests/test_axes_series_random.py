"""Axis-wise operators, series algebra and distributions against numpy."""

import numpy as np
import pytest
from numpy import polynomial as P
from pyspark.sql import functions as F

from gridloom.functions import random as rnd
from gridloom.operators import axes, series

X = np.random.default_rng(5).integers(-9, 9, size=(4, 6)).astype(float)


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(i, j, float(X[i, j])) for i in range(4) for j in range(6)], "i0 long, i1 long, v double")


def dense(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[f"i{k}"] for k in range(len(shape)))] = r[v]
    return out


@pytest.mark.parametrize("name", ["sum", "prod", "min", "max", "mean", "var", "std", "ptp", "all", "any", "count_nonzero", "median"])
def test_reductions_along_axes(matrix, name):
    f = getattr(np, name)
    for axis, k in (("i0", 0), ("i1", 1), (None, None)):
        got = axes.reduce_axes(matrix, name, "v", ["i0", "i1"], axis, keepdims=True)
        want = f(X, axis=k, keepdims=True)
        assert np.allclose(dense(got, want.shape), want)
    some = axes.reduce_axes(matrix, "sum", "v", ["i0", "i1"], "i1", where=F.col("v") > 0, initial=10.0)
    assert {r.i0: r.v for r in some.collect()} == dict(enumerate(np.sum(X, axis=1, where=X > 0, initial=10.0)))


def test_places_and_gather(spark, matrix):
    for name in ("argmin", "argmax"):
        got = {r.i0: r.place for r in axes.place_along(matrix, name, "v", ["i0", "i1"], "i1").collect()}
        assert got == dict(enumerate(getattr(X, name)(1).tolist()))
    order = np.argsort(X, axis=1, kind="stable")
    picks = spark.createDataFrame([(i, j, int(order[i, j]) - (6 if j % 2 else 0), float(j)) for i in range(4) for j in range(6)], "i0 long, i1 long, pick long, new double")
    assert (dense(axes.take_along_axis(matrix, picks, ["i0", "i1"], "i1", n=6), X.shape) == np.take_along_axis(X, order, 1)).all()
    want = X.copy()
    np.put_along_axis(want, np.arange(12).reshape(4, 3) % 2, np.arange(3.0), 1)
    few = spark.createDataFrame([(i, j, (3 * i + j) % 2, float(j)) for i in range(4) for j in range(3)], "i0 long, i1 long, pick long, new double")
    assert (dense(axes.put_along_axis(matrix, few, ["i0", "i1"], "i1"), X.shape) == want).all()
    assert sorted(tuple(r) for r in axes.argwhere(matrix, "v", ["i0", "i1"]).collect()) == sorted(map(tuple, np.argwhere(X).tolist()))
    assert sorted(r.idx for r in axes.flatnonzero(matrix, "v", ["i0", "i1"], (4, 6)).collect()) == np.flatnonzero(X).tolist()
    for lower, f in ((True, np.tril_indices), (False, np.triu_indices)):
        for k in (-1, 0, 2):
            assert sorted(tuple(r) for r in axes.triangle(spark, 4, 6, k, lower).collect()) == sorted(zip(*[x.tolist() for x in f(4, k, 6)], strict=True))
    lines = axes.apply_along_axis(matrix, np.cumsum, ["i0", "i1"], "i1").select("i0", F.col("idx").alias("i1"), F.col("value").alias("v"))
    assert (dense(lines, X.shape) == X.cumsum(1)).all()
    double = axes.vectorize(lambda a: 2 * a)
    assert sorted(r.x for r in matrix.select(double("v").alias("x")).collect()) == sorted((2 * X).ravel().tolist())


def test_vectors(spark):
    x = [3.0, 1.0, 1.0, 7.0, 3.0]
    v = spark.createDataFrame(list(enumerate(x)), "i long, v double")
    got = [r.value for r in axes.ediff1d(v, "i", "v", [-1.0], [8.0, 9.0]).orderBy("i").collect()]
    assert got == np.ediff1d(x, to_begin=[-1.0], to_end=[8.0, 9.0]).tolist()
    values, inverse = axes.unique_all(v, "v", "i")
    want = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    assert [(r.value, r["index"], r["count"]) for r in values.orderBy("place").collect()] == list(zip(want[0], want[1], want[3], strict=True))
    assert [r.inverse for r in inverse.orderBy("i").collect()] == want[2].tolist()
    y = np.array(x)
    np.place(y, y > 2, [10.0, 20.0])
    assert [r.v for r in axes.place(v, F.col("v") > 2, [10.0, 20.0], "i", "v").orderBy("i").collect()] == y.tolist()


def test_shapes(spark, matrix):
    assert axes.broadcast_shapes((3, 1), (4,), (1, 1, 4)) == np.broadcast_shapes((3, 1), (4,), (1, 1, 4))
    with pytest.raises(ValueError):
        axes.broadcast_shapes((3,), (4,))
    v = spark.createDataFrame([(i, float(i)) for i in range(6)], "i long, v double")
    assert (dense(axes.broadcast_to(v, ["i"], (6,), (4, 6)), (4, 6)) == np.broadcast_to(np.arange(6.0), (4, 6))).all()
    assert (dense(axes.column_stack([v, v.withColumn("v", -F.col("v"))], "i"), (6, 2)) == np.column_stack([np.arange(6.0), -np.arange(6.0)])).all()
    got = axes.block([[(matrix, 4, 6), (matrix, 4, 6)], [(matrix, 4, 6), (matrix, 4, 6)]])
    assert (dense(got, (8, 12)) == np.block([[X, X], [X, X]])).all()
    assert [p.count() for p in axes.array_split(v, "i", 6, 4)] == [len(p) for p in np.array_split(np.arange(6), 4)]
    assert (dense(axes.matrix_transpose(matrix, ["i0", "i1"]), (6, 4)) == X.T).all()
    assert axes.ndim_shape_size(matrix, ["i0", "i1"]) == (2, (4, 6), 24)
    assert axes.atleast_nd(matrix, ["i0", "i1"], 3)[1][:2] == ["i0", "i1"] and axes.squeeze(*axes.expand_dims(matrix, ["i0", "i1"], 1, "n"), (4, 1, 6))[1] == ["i0", "i1"]


KIND = {"power": P.polynomial, "chebyshev": P.chebyshev, "legendre": P.legendre, "hermite": P.hermite, "hermite_e": P.hermite_e, "laguerre": P.laguerre}
SHORT = {"power": "poly", "chebyshev": "cheb", "legendre": "leg", "hermite": "herm", "hermite_e": "herme", "laguerre": "lag"}


@pytest.mark.parametrize("kind", series.KINDS)
def test_series_algebra(kind, spark):
    f = lambda name: getattr(KIND[kind], SHORT[kind] + name)
    a, b = [1.0, -2.0, 0.5, 3.0], [2.0, 1.0, -1.5]
    assert np.allclose(series.mul(a, b, kind), f("mul")(a, b)) and np.allclose(series.mulx(a, kind), f("mulx")(a))
    for got, want in zip(series.divide(a, b, kind), f("div")(a, b), strict=True):
        assert np.allclose(got, want)
    assert np.allclose(series.power(b, 3, kind), f("pow")(b, 3)) and np.allclose(series.sub(a, b), f("sub")(a, b))
    assert np.allclose(series.derivative(a, 2, kind), f("der")(a, 2))
    assert np.allclose(series.integral(a, 2, kind, [1.0, 2.0], 0.5), f("int")(a, 2, [1.0, 2.0], 0.5))
    assert np.allclose(series.from_roots([1.0, -0.5, 2.0], kind), f("fromroots")([1.0, -0.5, 2.0]))
    assert np.allclose(series.roots(series.from_roots([1.0, -0.5, 2.0], kind), kind), [-0.5, 1.0, 2.0])
    assert np.allclose(series.line(1.5, -2.0, kind), f("line")(1.5, -2.0))
    c = np.arange(6.0).reshape(2, 3)
    row = spark.range(1).select(series.value_nd(c, [F.lit(0.3), F.lit(-0.7)], kind).alias("v"), F.array(*series.vander_nd([F.lit(0.3), F.lit(-0.7)], [1, 2], kind)).alias("w")).first()
    assert np.isclose(row.v, f("val2d")(0.3, -0.7, c)) and np.allclose(row.w, f("vander2d")(0.3, -0.7, [1, 2]))
    if kind != "power":
        assert np.allclose(series.to_power(a, kind), getattr(KIND[kind], f"{SHORT[kind]}2poly")(a))
        assert np.allclose(series.from_power(a, kind), getattr(KIND[kind], f"poly2{SHORT[kind]}")(a))
        x, w = series.gauss(6, kind)
        u, t = f("gauss")(6)
        assert np.allclose(x, u) and np.allclose(w, t)
        assert np.isclose(spark.range(1).select(series.weight(F.lit(0.4), kind).alias("v")).first().v, f("weight")(np.array(0.4)))


def test_chebyshev_points_and_domains():
    assert np.allclose(series.chebyshev_points(5), P.chebyshev.chebpts1(5)) and np.allclose(series.chebyshev_points(5, True), P.chebyshev.chebpts2(5))
    assert np.isclose(series.map_domain(0.3, [-1, 1], [2, 6]), P.polyutils.mapdomain(0.3, [-1, 1], [2, 6]))


MOMENTS = {
    "gamma": (lambda i: rnd.gamma(i, 1, 2.5, 2.0), 5.0, 10.0), "small gamma": (lambda i: rnd.gamma(i, 1, 0.4), 0.4, 0.4), "beta": (lambda i: rnd.beta(i, 1, 2.0, 3.0), 0.4, 0.04),
    "chisquare": (lambda i: rnd.chisquare(i, 1, 4.0), 4.0, 8.0), "noncentral_chisquare": (lambda i: rnd.noncentral_chisquare(i, 1, 4.0, 2.0), 6.0, 16.0), "f": (lambda i: rnd.f(i, 1, 5.0, 12.0), 1.2, 1.08),
    "standard_t": (lambda i: rnd.standard_t(i, 1, 9.0), 0.0, 9 / 7), "power": (lambda i: rnd.power(i, 1, 3.0), 0.75, 0.0375), "wald": (lambda i: rnd.wald(i, 1, 2.0, 5.0), 2.0, 1.6),
    "negative_binomial": (lambda i: rnd.negative_binomial(i, 1, 3.0, 0.4), 4.5, 11.25), "logseries": (lambda i: rnd.logseries(i, 1, 0.6), 1.637, 1.412), "hypergeometric": (lambda i: rnd.hypergeometric(i, 1, 15, 10, 6), 3.6, 1.14),
    "zipf": (lambda i: rnd.zipf(i, 1, 5.0), 1.0437, 0.0694), "vonmises": (lambda i: rnd.vonmises(i, 1, 0.5, 4.0), 0.5, 0.2875), "dirichlet": (lambda i: rnd.dirichlet(i, 1, [1.0, 2.0, 3.0])[1], 1 / 3, 0.0317),
    "multinomial": (lambda i: rnd.multinomial(i, 1, 10, [0.2, 0.3, 0.5])[2], 5.0, 2.5), "multivariate_normal": (lambda i: rnd.multivariate_normal(i, 1, [1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]])[1], 2.0, 1.0),
}


def test_moments_and_determinism(spark):
    n = 30_000
    draw = lambda parts: spark.range(0, n, 1, parts).select("id", *[f(F.col("id")).cast("double").alias(k) for k, (f, _, _) in MOMENTS.items()])
    row = draw(8).agg(*[x for k in MOMENTS for x in (F.avg(k).alias(f"m {k}"), F.var_pop(k).alias(f"v {k}"))]).first()
    for k, (_, mean, var) in MOMENTS.items():
        assert abs(row[f"m {k}"] - mean) < 6 * np.sqrt(var / n) + 1e-3, (k, row[f"m {k}"])
        assert abs(row[f"v {k}"] / var - 1) < 0.15, (k, row[f"v {k}"])
    assert draw(8).where("id < 50").orderBy("id").collect() == draw(3).where("id < 50").orderBy("id").collect()
