"""Sorting and searching; NaN sorts last in both directions and equal values keep the index order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scan import row_index


def sort_keys(v: str, descending: bool = False):
    x = F.col(v)
    return [F.isnan(x.cast("double")), x.desc() if descending else x.asc()]


def sort(df: DataFrame, v: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*sort_keys(v, descending))


def argsort(df: DataFrame, v: str, idx: str, by: Sequence[str] = (), descending: bool = False, out: str = "rank") -> DataFrame:
    """The place of every element in the sorted order of its line (all rows: in two passes over ranges)."""
    keys = [*sort_keys(v, descending), F.col(idx)]
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)) - 1)
    flat = df.withColumn("__n", keys[0]).withColumn("__v", -F.col(v) if descending else F.col(v))
    return row_index(flat, ["__n", "__v", idx], out).drop("__n", "__v")


def lexsort(df: DataFrame, keys: Sequence[str], idx: str, out: str = "rank") -> DataFrame:
    """The last key is the primary one."""
    return row_index(df, [*reversed(keys), idx], out)


def top_k(df: DataFrame, v: str, k: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(v).desc(), *tie).limit(k)


def partition_at(df: DataFrame, v: str, idx: str, kth: int, by: Sequence[str]) -> DataFrame:
    """Marks each element as before, at or after the kth place of its line."""
    ranked = argsort(df, v, idx, by)
    return ranked.withColumn("side", F.signum(F.col("rank") - kth).cast("int"))


def searchsorted(sorted_: DataFrame, a: str, keys: DataFrame, v: str, side: str = "left") -> DataFrame:
    """Insertion places of the keys, by one running count over both tables' distinct values (no pairwise comparison)."""
    counts = sorted_.groupBy(F.col(a).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    wanted = keys.select(F.col(v).cast("double").alias("__x")).distinct().withColumn("__n", F.lit(0))
    both = counts.unionByName(wanted).groupBy("__x").agg(F.sum("__n").alias("__n"))
    from gridloom.operators.scan import cumulative

    running = cumulative(both, "__n", "__x", "__c")
    place = running.select("__x", (F.col("__c") - F.col("__n") if side == "left" else F.col("__c")).cast("long").alias("place"))
    return keys.join(place, F.col(v).cast("double") == F.col("__x")).drop("__x")
