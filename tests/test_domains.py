"""Taper windows, masked domains, chains of matrices and packed bits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tapers
from gridloom.operators import bits, linalg, masked
from gridloom.sources import io


@pytest.mark.parametrize("n", [1, 2, 9])
def test_tapers(spark, n):
    names = ("hanning", "hamming", "blackman", "bartlett")
    rows = spark.range(n + 1).select("id", *[getattr(tapers, f)(F.col("id"), n).alias(f) for f in names]).orderBy("id").collect()
    for f in names:
        assert [r[f] for r in rows[:n]] == pytest.approx(getattr(np, f)(n).tolist(), abs=1e-12) and rows[n][f] is None


def test_geomspace(spark):
    for a, z, n in ((1.0, 1000.0, 4), (-2.0, -32.0, 5), (3.0, 3.0, 1)):
        got = [r.v for r in io.geomspace(spark, a, z, n).orderBy("idx").collect()]
        assert got == pytest.approx(np.geomspace(a, z, n).tolist()) and got[0] == a
    with pytest.raises(ValueError):
        io.geomspace(spark, -1.0, 1.0, 3)


def test_masked_functions(spark):
    cells = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0, 1e308, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x double")
    data = np.ma.masked_array([0.0 if x is None else x for x in cells], [x is None for x in cells])
    for f in ("log", "log2", "log10", "sqrt", "arcsin", "arccos", "arccosh", "arctanh", "tan"):
        got = [r.v for r in df.select("i", masked.masked_function(f, F.col("x")).alias("v")).orderBy("i").collect()]
        with np.errstate(all="ignore"):
            want = getattr(np.ma, f)(data)
        assert [v is None for v in got] == np.ma.getmaskarray(want).tolist(), f
        assert [v for v in got if v is not None] == pytest.approx(want.compressed().tolist(), rel=1e-9), f


def test_masked_quotients(spark):
    pairs = [(7.0, 2.0), (-7.0, 2.0), (7.0, -2.0), (-6.0, 2.0), (1.0, 0.0), (0.0, 0.0), (1e300, 1e-10), (5.0, 1e-320), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    a, b = (np.ma.masked_array([0.0 if p[k] is None else p[k] for p in pairs], [p[k] is None for p in pairs]) for k in (0, 1))
    for f in ("divide", "floor_divide", "remainder", "fmod"):
        got = [r.v for r in df.select("i", masked.masked_divide(f, F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
        with np.errstate(all="ignore"):
            want = getattr(np.ma, f)(a, b)
        assert [v is None for v in got] == np.ma.getmaskarray(want).tolist(), f
        small = [k for k, v in enumerate(got) if v is not None and abs(v) < 1e100]
        assert [got[k] for k in small] == pytest.approx([want[k] for k in small]), f


def test_chain_of_matrices(spark):
    rng, sizes = np.random.default_rng(0), (3, 7, 2, 5, 4)
    dense = [rng.normal(size=s) for s in zip(sizes, sizes[1:], strict=False)]
    cells = [spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.ndindex(m.shape)], "i0 int, i1 int, v double") for m in dense]
    want = np.linalg.multi_dot(dense)
    assert {(r.i0, r.i1): r.v for r in linalg.multi_dot(cells, sizes).collect()} == pytest.approx({(i, j): want[i, j] for i, j in np.ndindex(want.shape)})


@pytest.mark.parametrize("little", [False, True])
def test_bits_round_trip(spark, little):
    flags = [bool(x) for x in np.random.default_rng(1).integers(0, 2, 29)]
    packed = bits.packbits(spark.createDataFrame(list(enumerate(flags)), "idx long, flag boolean"), "idx", "flag", little)
    assert [r.v for r in packed.orderBy("idx").collect()] == np.packbits(flags, bitorder="little" if little else "big").tolist()
    assert [bool(r.flag) for r in bits.unpackbits(packed, count=29, little=little).orderBy("idx").collect()] == flags
