"""Projections: value translation, labels and boolean columns, key levels, time stamps, struct and map columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def drop_values(df: DataFrame, values: Mapping) -> DataFrame:
    """Rows without any of the values; nulls stay."""
    for c, v in values.items():
        df = df.where(~F.col(c).eqNullSafe(F.lit(v)))
    return df


def one_hot(df: DataFrame, label: str, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A boolean column per label."""
    return df.select(*keep, *(F.col(label).eqNullSafe(F.lit(b)).alias(b) for b in labels))


def labels_of(df: DataFrame, labels: Sequence[str], name: str = "labels") -> DataFrame:
    """The labels whose columns are true, as an array in the order given."""
    return df.withColumn(name, F.array_compact(F.array(*(F.when(F.col(b), F.lit(b)) for b in labels)))).drop(*labels)


def expand_map(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """A column per key of a map."""
    return df.select("*", *(F.col(column)[k].alias(k) for k in keys)).drop(column)


def expand_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON text as columns."""
    return df.withColumn("_s", F.from_json(column, schema)).select(*(c for c in df.columns if c != column), "_s.*")


def expand_array(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)))


def constant_keys(df: DataFrame, keys: Mapping) -> DataFrame:
    """Constant key columns in front."""
    return df.select(*(F.lit(v).alias(k) for k, v in keys.items()), "*")


def insert_column(df: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    names = df.columns
    return df.select(*names[:position], value.alias(name), *names[position:])


def key_numbers(df: DataFrame, keys: Sequence[str], name: str = "combined_idx") -> tuple[DataFrame, DataFrame]:
    """(df with the keys replaced by their number in sorted order, the mapping). Only the distinct keys are ranked."""
    distinct = df.select(*keys).distinct()
    mapping = distinct.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
    renamed = mapping.select(*(F.col(c).alias(f"_k_{c}") for c in keys), name)
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(renamed, on).select(name, *(c for c in df.columns if c not in keys)), mapping


def split_by(df: DataFrame, flag: Column, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables of the same rows: the columns where the flag is false, and where it is true, null elsewhere."""
    return df.withColumns({c: F.when(~flag, F.col(c)) for c in columns}), df.withColumns({c: F.when(flag, F.col(c)) for c in columns})


def frame_of(msec: Column, fps: float) -> Column:
    """The frame in which a time stamp lies."""
    return (msec / 1000 * fps).cast("long")


def msec_of(frame: Column, fps: float) -> Column:
    return frame / fps * 1000


def interval_of(frames: Column, fps: float = 30) -> Column:
    """Frames as a day-time interval."""
    return F.make_dt_interval(secs=(frames / fps).cast("decimal(18,6)"))


def update_missing(a: Column, b: Column) -> Column:
    """a, or b where a is missing."""
    return F.coalesce(a, b)


def masked(value: Column, mask: Column, fill=None) -> Column:
    return F.when(mask, value).otherwise(F.lit(fill))


def group_names(df: DataFrame, groups: Sequence[str], template: str, name: str = "name") -> DataFrame:
    """Distinct groups with a name by a printf template."""
    return df.select(*groups).distinct().withColumn(name, F.format_string(template, *groups))


def _flat(column: Column, kind: T.DataType, path: tuple[str, ...], separator: str) -> list[Column]:
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _flat(column.getField(f.name), f.dataType, (*path, f.name), separator)]
    return [column.alias(separator.join(path))]


def flatten_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested columns as plain ones, named by their path."""
    return df.select(*(c for f in df.schema.fields for c in _flat(F.col(f"`{f.name}`"), f.dataType, (f.name,), separator)))


def flatten_keys(df: DataFrame, keys: Sequence[str], name: str = "key", separator: str = "/") -> DataFrame:
    """All keys as one struct in front, and nested columns by their path."""
    values = (c for f in df.schema.fields if f.name not in keys for c in _flat(F.col(f"`{f.name}`"), f.dataType, (f.name,), separator))
    return df.select(F.struct(*keys).alias(name), *values)
