"""Elementwise operators and running window counts over streams: the same expressions, on an unbounded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elementwise(stream: DataFrame, **columns: Column) -> DataFrame:
    return stream.withColumns(columns)


def windowed(stream: DataFrame, ts: str, width: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Tumbling windows with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
