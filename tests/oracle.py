"""Runs SQL over the test tables and compares row sets, columns by name and floats to six places."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else (str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v)
    rows = [tuple(None if pd.isna(v) else plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql).df()


def check(query, sql: str, spark, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
