"""Queries against their SQL on rows that the small tables lack."""

import os

import duckdb
import numpy as np
import pytest
from oracle import TABLES, check

from gridloom import registry
from gridloom.operators import linalg, reduce


@pytest.fixture
def tables(sf_dir, tmp_path):
    """Makes a folder of the test tables, some of them replaced by the rows of a SELECT over the old ones."""

    def made(**selects):
        con = duckdb.connect()
        for name in TABLES:
            old, new = f"{sf_dir}/{name}.parquet", f"{tmp_path}/{name}.parquet"
            if name in selects:
                con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{old}'")
                con.sql(f"COPY ({selects[name]}) TO '{new}' (FORMAT parquet)")
            else:
                os.symlink(os.path.abspath(old), new)
        return str(tmp_path)

    return made


def same(name, spark, d):
    check(registry.QUERIES[name], registry.ORACLES[name], spark, d)


def test_unwrap_at_exactly_half_a_period(spark, tables):
    halves = "SELECT event_id, ts, event_id // 12 AS user_id, event_type, [0.0, 50, 0, -50, 100, -50, 0.25, 50.25, 200.25, 49.25, 99.25, NULL][event_id % 12 + 1] AS value, props FROM events WHERE event_id < 60"
    same("unwrap_phase", spark, tables(events=halves))


def test_reduceat_ends_where_its_sql_does(spark, tables):
    d = tables(part="SELECT p_partkey + 999900 * k AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part, range(2) t(k)")
    same("reduceat_segments", spark, d)
    part = spark.read.parquet(f"{d}/part.parquet")
    whole = {r.segment: r.value for r in reduce.reduceat(part, "p_size", "p_partkey", [0, 100]).collect()}
    assert whole[1] == part.where("p_partkey >= 100").agg({"p_size": "sum"}).first()[0]  # the operator's own last segment has no end


ODD = """SELECT unnest([1, 2, 3, 4, 4, 5, 6, 7, 8, NULL]::BIGINT[]) AS vec_id, unnest([[1.0, 2, 3], [0.5, -1, 2], [1, 2], [3, NULL, 1], [1, 1, 4], [], NULL, [NULL, NULL, 7], [2, 1], [-2, 0.25, 1]]::FLOAT[][]) AS embedding, 0 AS label"""


@pytest.mark.parametrize("block", [2, 1024])
def test_pair_dots_of_odd_rows(spark, tables, monkeypatch, block):
    monkeypatch.setattr(linalg, "PAIR_ROWS", block)
    monkeypatch.setattr(linalg, "PAIR_CELLS", 3)
    same("einsum_pair_dot_whole", spark, tables(embeddings=ODD))


def test_pair_dots_keep_infinities_to_shared_places(spark, tables, monkeypatch):
    monkeypatch.setattr(linalg, "PAIR_ROWS", 2)
    same("einsum_pair_dot_whole", spark, tables(embeddings="SELECT unnest([1, 2, 3]) AS vec_id, unnest([[1.0, 2, 'inf'::FLOAT], [3, 4], [NULL, 1, 1]]::FLOAT[][]) AS embedding, 0 AS label"))


def test_pair_dots_of_no_rows(spark, tables):
    assert registry.QUERIES["einsum_pair_dot_whole"](spark, tables(embeddings="SELECT * FROM embeddings WHERE false")).count() == 0


def test_pair_dots_are_dense_products_and_not_sums_of_joined_cells(spark, tables):
    d = tables(embeddings="SELECT vec_id + 500 * k AS vec_id, list_transform(embedding, lambda x: x + k) AS embedding, label FROM embeddings, range(6) t(k)")
    out = registry.QUERIES["einsum_pair_dot_whole"](spark, d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is summed by pair after the join: before, 64 rows for each pair
    got = out.toPandas().sort_values(["i0", "i1"])
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{d}/embeddings.parquet' ORDER BY vec_id").df()
    x = np.stack(e.embedding).astype(float)
    assert len(got) == len(x) ** 2
    assert np.array_equal(got.i0, np.repeat(e.vec_id, len(x))) and np.array_equal(got.i1, np.tile(e.vec_id, len(x)))
    assert np.abs(got.v.to_numpy() - (x @ x.T).ravel()).max() < 5.1e-5
