"""Readers and writers: delimited text, .npy and raw binary arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def loadtxt(spark: SparkSession, path: str, schema: str, delimiter: str = ",", comments: str = "#", skip_header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=delimiter, comment=comments, header=skip_header, mode="FAILFAST")


def genfromtxt(spark: SparkSession, path: str, schema: str, delimiter: str = ",", missing: str = "", filling: dict | None = None, skip_header: bool = True) -> DataFrame:
    """Cells that don't parse or equal ``missing`` are masked, then filled where a value is given."""
    out = spark.read.csv(path, schema=schema, sep=delimiter, header=skip_header, nullValue=missing, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return out.fillna(filling) if filling else out


def fromregex(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """One row per line that matches; group k becomes the k-th field."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).cast(t).alias(n) for k, (n, t) in enumerate(fields.items())])


def savetxt(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=delimiter, header=header)


def load_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, v) of numeric .npy files, a file per task; elements are in C order."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                flat = np.load(io.BytesIO(data.as_py()), allow_pickle=False).ravel().astype(float)
                for i in range(0, len(flat), 1 << 16):
                    part = flat[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(part)], ["path", "idx", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, v double")


def fromfile(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """(path, idx, v) of raw binary files."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                flat = np.frombuffer(data.as_py(), dtype).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], ["path", "idx", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, v double")


def arange(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    n = max(0, -((start - stop) // step))
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * step + start).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, n: int, endpoint: bool = True) -> DataFrame:
    gap = (stop - start) / max(n - endpoint, 1)
    return spark.range(n).select(F.col("id").alias("idx"), F.when(F.lit(endpoint) & (F.col("id") == n - 1) & F.lit(n > 1), float(stop)).otherwise(F.col("id") * gap + start).alias("v"))


def logspace(spark: SparkSession, start: float, stop: float, n: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, stop, n).withColumn("v", F.pow(F.lit(base), F.col("v")))


def geomspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """Both ends exact, equal ratios between; the ends have one sign."""
    if start * stop <= 0:
        raise ValueError("the ends of a geometric sequence are both positive or both negative")
    inner = F.pow(F.lit(stop / start), F.col("id") / float(max(n - 1, 1))) * float(start)
    return spark.range(n).select(F.col("id").alias("idx"), F.when(F.col("id") == 0, float(start)).when(F.col("id") == n - 1, float(stop)).otherwise(inner).alias("v"))


def full(spark: SparkSession, shape: tuple[int, ...], value) -> DataFrame:
    from gridloom.operators.indexing import unravel_index

    size = 1
    for s in shape:
        size *= s
    return spark.range(size).select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(unravel_index(F.col("id"), shape))], F.lit(value).alias("v"))


def eye(spark: SparkSession, n: int, k: int = 0) -> DataFrame:
    return full(spark, (n, n), 0.0).withColumn("v", F.when(F.col("i1") - F.col("i0") == k, 1.0).otherwise(0.0))


def vander(df: DataFrame, v: str, n: int) -> DataFrame:
    return df.select("*", *[F.pow(F.col(v), F.lit(float(n - 1 - k))).alias(f"p{k}") for k in range(n)])


def meshgrid(*axes: DataFrame) -> DataFrame:
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out
