import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import types
from gridloom.functions import datetimes, random, strings
from gridloom.functions import ufuncs as u
from gridloom.operators import fft, indexing, linalg, ordering, poly, records, reduce, scan, shape
from gridloom.sources import io

SPECIAL = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, -1.0, 5e-324, 1e300, 2.0, -2.0, 2.5, 3.5, -7.25, 0.1]


def _one(spark, column, rows, kind="double"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("name", ["absolute", "ceil", "floor", "trunc", "rint", "sqrt", "cbrt", "exp", "log", "log2", "log10", "log1p", "sign", "isnan", "isinf", "isfinite", "signbit", "reciprocal", "square", "arctan", "tanh", "spacing"])
def test_unary_special_values(spark, name):
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array(SPECIAL))
    got = np.array(_one(spark, u.ufunc(name, F.col("x")), SPECIAL), dtype=want.dtype)
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-12)


@pytest.mark.parametrize("name", ["maximum", "minimum", "fmax", "fmin", "greater", "less_equal", "equal", "not_equal", "divide", "copysign", "hypot", "logaddexp", "nextafter"])
def test_binary_special_values(spark, name):
    pairs = [(a, b) for a in SPECIAL for b in SPECIAL if not (name == "logaddexp" and (np.isinf(a) or np.isinf(b)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, x double, y double")
    got = [r[0] for r in df.orderBy("i").select(u.ufunc(name, F.col("x"), F.col("y"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(*np.array(pairs).T)
    np.testing.assert_allclose(np.array(got, float), want.astype(float), rtol=1e-9)


@pytest.mark.parametrize("name", ["floor_divide", "remainder", "gcd", "lcm", "left_shift", "right_shift", "bitwise_xor"])
def test_integer_pairs(spark, name):
    pairs = [(a, b) for a in (-9, -7, -1, 0, 1, 5, 12, 90) for b in ((-5, -2, 0, 3, 4) if "shift" not in name else (0, 1, 5, 63, 64, 90))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, x long, y long")
    got = [r[0] for r in df.orderBy("i").select(u.ufunc(name, F.col("x"), F.col("y"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(*np.array(pairs).T)
    assert [int(g) for g in got] == want.tolist()


def test_frexp_and_wrap(spark):
    got = _one(spark, u.ufunc("frexp", F.col("x")), [8.0, 0.3, -5.0, 0.0])
    assert [(g.mantissa, g.exponent) for g in got] == [(float(np.frexp(v)[0]), int(np.frexp(v)[1])) for v in (8.0, 0.3, -5.0, 0.0)]
    wide = (F.col("x").cast("decimal(38,0)") + 1)
    assert _one(spark, types.wrap(wide, "int64"), [2**63 - 1, -1], "long") == [-(2**63), 0]
    assert _one(spark, types.wrap(wide, "uint8"), [255, 300], "long") == [0, 45]


def test_promotion_lattice():
    for a in types.KINDS:
        for b in types.KINDS:
            assert types.promote(a, b) == np.promote_types(a, b).name, (a, b)


@pytest.mark.parametrize("method", reduce.METHODS)
def test_quantile_methods(spark, method):
    rng = np.random.default_rng(3)
    data = {k: np.round(rng.normal(size=n), 1) for k, n in (("a", 1), ("b", 4), ("c", 17), ("d", 50))}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    for r in reduce.quantile(df, "x", qs, ["k"], method).collect():
        assert r.value == pytest.approx(np.quantile(data[r.k], r.q, method=method), abs=1e-9), (r.k, r.q)


@pytest.mark.parametrize("rule", ["sqrt", "sturges", "rice", "scott", "fd", "doane", "auto"])
def test_histogram_edges(spark, rule):
    x = np.random.default_rng(5).gamma(2.0, size=400)
    got = reduce.histogram_bin_edges(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", rule)
    np.testing.assert_allclose(got, np.histogram_bin_edges(x, rule), rtol=1e-9)


def test_strings(spark):
    text = ["  ADA_Lovelace ", "grace_HOPPER", "a\tbc\td", "it's o'clock", ""]
    for f, g in ((strings.title, str.title), (strings.swapcase, str.swapcase), (strings.capitalize, str.capitalize), (strings.strip, str.strip), (strings.expandtabs, str.expandtabs), (lambda c: strings.center(c, 17, "*"), lambda s: s.center(17, "*")), (lambda c: strings.zfill(c, 9), lambda s: s.zfill(9)), (lambda c: strings.rfind(c, "o"), lambda s: s.rfind("o")), (lambda c: strings.replace(c, "a", "XY", 1), lambda s: s.replace("a", "XY", 1)), (lambda c: strings.rpartition(c, "_"), lambda s: list(s.rpartition("_"))), (lambda c: strings.find(c, "c", 3), lambda s: s.find("c", 3)), (strings.isupper, str.isupper), (strings.islower, str.islower), (strings.istitle, str.istitle)):
        assert _one(spark, f(F.col("x")), text, "string") == [g(s) for s in text]


def test_business_days(spark):
    days = [str(np.datetime64("2024-02-20") + k) for k in range(20)]
    holidays = ["2024-02-29", "2024-03-02"]
    d = F.to_date(F.col("x"))
    assert _one(spark, datetimes.is_busday(d, holidays=holidays), days, "string") == np.is_busday(days, holidays=holidays).tolist()
    for n in (-6, -1, 0, 3, 11):
        for how in ("forward", "backward", "modifiedfollowing"):
            assert [str(x) for x in _one(spark, datetimes.busday_offset(d, n, how, holidays=holidays), days, "string")] == [str(x) for x in np.busday_offset(days, n, how, holidays=holidays)]
    for end in ("2024-02-10", "2024-04-01"):
        assert _one(spark, datetimes.busday_count(d, F.to_date(F.lit(end)), holidays=holidays), days, "string") == np.busday_count(days, end, holidays=holidays).tolist()


def _matrix(spark, a, key=None):
    rows = [((key or 0), i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "b int, i0 int, i1 int, v double")


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    got = {(r.i0, r.i1): r.v for r in linalg.matmul(_matrix(spark, a).drop("b"), _matrix(spark, b).drop("b")).collect()}
    for (i, j), v in got.items():
        assert v == pytest.approx((a @ b)[i, j])
    s = rng.normal(size=(3, 3))
    cells = {(r.part, r.i, r.j): r.value for r in linalg.decompose(_matrix(spark, s), "inv").collect()}
    np.testing.assert_allclose([[cells["inv", i, j] for j in range(3)] for i in range(3)], np.linalg.inv(s))
    both = linalg.einsum("ij,kj,ik->", *[_matrix(spark, m).drop("b") for m in (a, a, np.ones((3, 3)))]).first().v
    assert both == pytest.approx(np.einsum("ij,kj,ik->", a, a, np.ones((3, 3))))


def test_fft_and_polynomials(spark):
    x = [1.0, 2.0, -1.0, 0.5, 4.0]
    row = fft.transform(spark.createDataFrame([(x,)], "x array<double>"), "x", kind="rfft", norm="ortho").first()
    np.testing.assert_allclose(np.array(row.out_re) + 1j * np.array(row.out_im), np.fft.rfft(x, norm="ortho"))
    p = np.polynomial
    for kind, f in (("chebyshev", p.chebyshev.chebval), ("legendre", p.legendre.legval), ("hermite", p.hermite.hermval), ("hermite_e", p.hermite_e.hermeval), ("laguerre", p.laguerre.lagval)):
        np.testing.assert_allclose(_one(spark, poly.series_value(F.col("x"), [1, 2, 0.5, -1], kind), x), f(np.array(x), [1, 2, 0.5, -1]))
    two = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0, 1.0])], "a array<double>, b array<double>")
    assert two.select(poly.mul(F.col("a"), F.col("b")), poly.deriv(F.col("b")), poly.add(F.col("a"), F.col("b"))).first()[:] == ([3.0, 6.0, 1.0, 2.0], [0.0, 2.0], [4.0, 2.0, 1.0])
    roots = poly.roots(spark.createDataFrame([([6.0, -5.0, 1.0],)], "c array<double>"), "c").first()
    np.testing.assert_allclose(roots.root_re, [2, 3])


def test_layout(spark):
    a = np.arange(12.0).reshape(3, 4)
    df = _matrix(spark, a).drop("b")

    def dense(rows, r, c):
        out = np.full((r, c), np.nan)
        for x in rows.collect():
            out[x.i0, x.i1] = x.v
        return out

    np.testing.assert_array_equal(dense(shape.rot90(df, "i0", "i1", 3, 4), 4, 3), np.rot90(a))
    for mode in ("reflect", "symmetric", "wrap", "edge", "constant"):
        np.testing.assert_array_equal(dense(shape.pad(df, "i1", 4, 2, 3, mode, 0.0), 3, 9), np.pad(a, ((0, 0), (2, 3)), mode))
    np.testing.assert_array_equal(dense(shape.repeat(df, "i0", 2), 6, 4), np.repeat(a, 2, 0))
    x = spark.createDataFrame([(i, float(i * i)) for i in range(9)], "i long, v double")
    for mode in ("full", "same", "valid"):
        got = [r.value for r in scan.convolve(x, "v", "i", [1, -2, 0.5, 3], mode, 9).orderBy("i").collect()]
        np.testing.assert_allclose(got, np.convolve(np.arange(9.0) ** 2, [1, -2, 0.5, 3], mode))
    assert [r.v for r in indexing.slice_rows(x, "i", 7, 1, -2, 9).orderBy("i").collect()] == (np.arange(9.0) ** 2)[7:1:-2].tolist()


def test_records_and_search(spark):
    left = spark.createDataFrame([(1,), (2,)], "a int")
    right = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "b double")
    assert sorted(map(tuple, records.merge_arrays(left, right, (["a"], ["b"]), {"a": -1}).collect())) == [(-1, 30.0), (1, 10.0), (2, 20.0)]
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 5)], "x double")
    keys = spark.createDataFrame([(float(x),) for x in (0, 2, 5, 9)], "y double")
    for side in ("left", "right"):
        got = {r.y: r.place for r in ordering.searchsorted(a, "x", keys, "y", side).collect()}
        assert got == {k: int(np.searchsorted([1, 2, 2, 5], k, side)) for k in got} and len(got) == 4


def test_random_columns(spark):
    df = spark.range(20000)
    i = F.col("id")
    m = df.select(F.avg(random.uniform(i, 1)), F.avg(random.normal(i, 1, 2.0, 3.0)), F.stddev(random.normal(i, 1, 2.0, 3.0)), F.avg(random.exponential(i, 2, 4.0)), F.avg(random.poisson(i, 3, 2.5)), F.avg(random.binomial(i, 4, 10, 0.3)), F.avg(random.geometric(i, 5, 0.25))).first()
    np.testing.assert_allclose(m[:], [0.5, 2.0, 3.0, 4.0, 2.5, 3.0, 4.0], rtol=0.05)
    places = [r.place for r in random.permutation(spark.range(50), "id", 7).orderBy("id").collect()]
    assert sorted(places) == list(range(50)) and places != sorted(places)


def test_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    assert [r.v for r in io.load_npy(spark, str(tmp_path / "a.npy")).orderBy("idx").collect()] == list(range(6))
    (tmp_path / "t.csv").write_text("id,name,score\n103,Linus,7.75\n101,Ada,\n")
    got = io.genfromtxt(spark, str(tmp_path / "t.csv"), "id int, name string, score double", filling={"score": -1.0})
    assert sorted(map(tuple, got.collect())) == [(101, "Ada", -1.0), (103, "Linus", 7.75)]
    assert [r.v for r in io.linspace(spark, 0, 1, 5).orderBy("idx").collect()] == [0, 0.25, 0.5, 0.75, 1]
