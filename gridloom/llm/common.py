"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.ship import ship


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds what a Python worker gets at once: rows, and bytes, as texts can be very long."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # the default; whole texts are long rows
        spark.conf.set(rows, "2000")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, "4m")
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and everything runs in this one process, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes the rows to a table in the shared folder (with the writer's options) and reads them back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that no result still reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the wanted columns, by their inner names: other columns can't clash."""
    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def _release() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks, and stages without Python need the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(batches: Iterator) -> Iterator:
    """The same batches; the worker's spare memory is released after the last."""
    try:
        yield from batches
    finally:
        _release()


class Latest:
    """What a Python worker built from a broadcast, kept for its next tasks; another broadcast replaces it.

    The broadcast itself is held, so that its identity can't be taken by a later one.
    """

    def __init__(self) -> None:
        self.source, self.slot, self.value = None, None, None

    def get(self, source, build, slot: int = 0):
        if self.source is not source or self.slot != slot:
            self.value = None
            self.value, self.source, self.slot = build(source.value), source, slot
        return self.value
