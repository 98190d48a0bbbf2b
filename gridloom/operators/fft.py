"""Discrete Fourier transforms of many signals: one array per row, transformed in Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("fft", "ifft", "rfft", "irfft", "hfft", "ihfft")


def transform(df: DataFrame, re: str, im: str | None = None, kind: str = "fft", n: int | None = None, norm: str = "backward") -> DataFrame:
    """Adds ``out_re`` and ``out_im`` arrays."""
    if kind not in KINDS:
        raise ValueError(f"unknown transform {kind}")
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("out_re", ArrayType(DoubleType())), StructField("out_im", ArrayType(DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            res, ims = [], []
            for r, x in enumerate(batch[re].to_pylist()):
                z = np.asarray(x or [], float)
                if im:
                    z = z + 1j * np.asarray(batch[im][r].as_py() or [], float)
                out = np.asarray(getattr(np.fft, kind)(z, n=n, norm=norm)) if len(z) else np.zeros(0)
                res.append(out.real.tolist())
                ims.append(out.imag.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(res, pa.list_(pa.float64())), pa.array(ims, pa.list_(pa.float64()))], [*batch.schema.names, "out_re", "out_im"])

    return df.mapInArrow(run, schema)


def dft(df: DataFrame, idx: str, v: str, n: int, by: str) -> DataFrame:
    """Rows (by, k, re, im) by direct summation, for long-form signals of a short length n."""
    ks = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    turn = (F.col("k") * F.col(idx) % n) * (-2 * math.pi / n)
    return ks.groupBy(by, "k").agg(F.sum(F.col(v) * F.cos(turn)).alias("re"), F.sum(F.col(v) * F.sin(turn)).alias("im"))


def fftfreq(k, n: int, d: float = 1.0):
    return F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * d)


def rfftfreq(k, n: int, d: float = 1.0):
    return k / (n * d)


def fftshift(df: DataFrame, k: str, n: int, inverse: bool = False) -> DataFrame:
    return df.withColumn(k, F.pmod(F.col(k) + (-(n // 2) if inverse else n // 2), F.lit(n)))
