"""Record arrays: rows with named fields, joined by key or by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scan import row_index

_HOW = {"inner": "inner", "outer": "full", "leftouter": "left"}


def join_by(keys: Sequence[str], left: DataFrame, right: DataFrame, how: str = "inner", postfixes: tuple[str, str] = ("1", "2"), defaults: dict | None = None) -> DataFrame:
    """Equi join; clashing fields get the postfixes, missing cells the defaults."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select(*[F.col(c).alias(c + postfixes[0]) if c in clash else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + postfixes[1]) if c in clash else F.col(c) for c in right.columns])
    out = a.join(b, list(keys), _HOW[how])
    return out.fillna(defaults) if defaults else out


def merge_arrays(left: DataFrame, right: DataFrame, order: tuple[Sequence[str], Sequence[str]], fill: dict | None = None) -> DataFrame:
    """Positional join: the i-th row beside the i-th row, the shorter side filled."""
    a, b = row_index(left, order[0], "__i"), row_index(right, order[1], "__i")
    out = a.join(b, "__i", "full").drop("__i")
    return out.fillna(fill) if fill else out


def stack_arrays(*parts: DataFrame) -> DataFrame:
    """Rows under each other; fields that a part lacks are masked."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def find_duplicates(df: DataFrame, keys: Sequence[str], ignore_mask: bool = True) -> DataFrame:
    """Rows whose key occurs more than once; masked (NULL) keys don't count."""
    rows = df.dropna(subset=list(keys)) if ignore_mask else df
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return rows.join(counts, list(keys), "left_semi")


def drop_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def keep_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def append_fields(df: DataFrame, **columns) -> DataFrame:
    return df.withColumns(columns)


def apply_along_fields(df: DataFrame, f, fields: Sequence[str], out: str = "value") -> DataFrame:
    """A function of an array of the fields' values, per row."""
    return df.withColumn(out, f(F.array(*[F.col(c).cast("double") for c in fields])))


def structured_to_unstructured(df: DataFrame, fields: Sequence[str], out: str = "values") -> DataFrame:
    return df.select(*[c for c in df.columns if c not in fields], F.array(*[F.col(c).cast("double") for c in fields]).alias(out))


def unstructured_to_structured(df: DataFrame, values: str, fields: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != values], *[F.col(values)[i].alias(f) for i, f in enumerate(fields)])


def flatten_descr(df: DataFrame) -> DataFrame:
    """Nested fields as top-level columns, named by their path."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, prefix: str = ""):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, f"{prefix}{f.name}.")
            else:
                yield prefix + f.name

    return df.select(*[F.col(p).alias(p.replace(".", "_")) for p in leaves(df.schema)])


def recursive_fill(df: DataFrame, fill: float) -> DataFrame:
    return df.fillna(fill)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
