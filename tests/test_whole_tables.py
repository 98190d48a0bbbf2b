"""The whole-table queries reach rows and columns that the small ones cut off."""

import numpy as np
import pytest

from gridloom import registry
from gridloom.operators import linalg

CUT = ["transpose_flip", "reshape_ravel", "tril_trace", "pad_reflect", "take_wrap", "merge_positional", "matmul_gram", "einsum_pair_dot", "norm_rows", "det_blocks", "dft_long"]


@pytest.mark.parametrize("name", CUT)
def test_has_a_whole_table_query_without_a_literal_cut(name):
    assert name not in registry.QUERIES
    sql = registry.ORACLES[f"{name}_whole"]
    assert "vec_id <" not in sql and "s_suppkey <=" not in sql and "i1 <" not in sql.replace("i1 <= i0", "")


def test_whole_tables_reach_every_vector(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert n > 40
    run = lambda name: registry.QUERIES[name](spark, sf_dir)
    assert run("norm_rows_whole").count() == n
    assert run("pad_reflect_whole").count() == n + 6
    assert run("matmul_gram_whole").count() == 64 * 65 // 2
    assert run("det_blocks_whole").count() == n // 2 * 32
    assert run("merge_positional_whole").count() == max(spark.read.parquet(f"{sf_dir}/supplier.parquet").count(), 5)


def test_gram_and_pair_dets_against_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(5, 6))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k long, a array<double>").repartition(3)
    got = {(r.i, r.j): r.v for r in linalg.gram_batches(rows, "a").collect()}
    want = x.T @ x
    assert len(got) == 21 and all(abs(v - want[c]) < 1e-9 for c, v in got.items())
    cells = spark.createDataFrame([(k // 2, k % 2, j, float(x[k, j])) for k in range(5) for j in range(6)], "b long, i0 long, i1 long, v double")
    dets = {(r.b, r.j): r.value for r in linalg.pair_dets(cells).collect()}
    assert len(dets) == 9 and all(dets[2, j] is None for j in range(3))
    assert all(abs(dets[b, j] - np.linalg.det(x[2 * b : 2 * b + 2, 2 * j : 2 * j + 2])) < 1e-9 for b in range(2) for j in range(3))
