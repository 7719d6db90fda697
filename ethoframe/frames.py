"""Conventions of frame tables: id columns are partition keys, one column orders the rows of an id, missing values are null."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FRAME = "frame_index"


def ordered(ids: Sequence[str], order: str | Sequence[str] = FRAME) -> WindowSpec:
    """Rows of an id in order. Without ids all rows are one series, which one task must sort."""
    by = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*ids).orderBy(*by)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every float column as null, so that there is one kind of missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def same(a: DataFrame, b: DataFrame, columns: Iterable[str]) -> Column:
    """Null-safe equality on columns of two frames, for joins on keys that may be null."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns), F.lit(True))


def frame_numbers(df: DataFrame, ids: Sequence[str], order: Sequence[str], name: str = FRAME) -> DataFrame:
    """Number the rows of each id from 1 in the given order."""
    return df.withColumn(name, F.row_number().over(ordered(ids, order)).cast("long"))
