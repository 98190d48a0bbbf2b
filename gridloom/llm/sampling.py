"""Bounded training samples, chosen by a hash of the id so that every run takes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Class counts are broadcast up to so many classes.
CLASSES = 10_000
_SCALE = 1 << 30


def per_class(rows: DataFrame, label: str, key: str, target: int) -> DataFrame:
    """About ``target`` rows of every class (all of a smaller one): the rows whose hashed key is below the class's share.

    No class is gathered anywhere; a class's share follows from its count, in one aggregation of
    one row per class.
    """
    counts = stored(rows.groupBy(label).agg(F.count("*").alias("__n")), "classes")
    if counts.count() <= CLASSES:
        counts = F.broadcast(counts)
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(_SCALE))
    return rows.join(counts, label).where(spot * F.col("__n") < F.lit(float(target)) * _SCALE).drop("__n")
