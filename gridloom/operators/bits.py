"""Packing of flags into bytes and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packbits(df: DataFrame, idx: str, flag: str, little: bool = False) -> DataFrame:
    """Eight flags a byte (idx, v): flag k is bit 7 - k % 8 of byte k // 8, or bit k % 8 if ``little``; absent and null flags are 0."""
    weights = F.array(*[F.lit(1 << (k if little else 7 - k)) for k in range(8)])
    bit = weights[(F.col(idx) % 8).cast("int")]
    return df.groupBy(F.expr(f"`{idx}` div 8").alias("idx")).agg(F.coalesce(F.sum(F.when(F.col(flag).cast("boolean"), bit)), F.lit(0)).cast("int").alias("v"))


def unpackbits(df: DataFrame, idx: str = "idx", v: str = "v", count: int | None = None, little: bool = False) -> DataFrame:
    """The flags of every byte as rows (idx, flag 0 or 1), ``count`` of them if given; no shuffle."""
    rows = df.select(F.col(idx).alias("__byte"), F.col(v).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("__k"))
    place = F.col("__k") if little else 7 - F.col("__k")
    out = rows.select((F.col("__byte") * 8 + F.col("__k")).alias("idx"), F.getbit(F.col("__v"), place).cast("int").alias("flag"))
    return out if count is None else out.where(F.col("idx") < count)
