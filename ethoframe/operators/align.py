"""Alignment of frame tables: key unions, grids, neighbourhoods and as-of lookups, all as equi joins or ordered windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME, same


def key_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (f.select(*keys) for f in frames)).distinct()


def key_intersection(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.intersect, (f.select(*keys) for f in frames)).distinct()


def reindex(df: DataFrame, index: DataFrame, keys: Sequence[str], fill: Mapping | None = None) -> DataFrame:
    """A row of df for every key of index, nulls (or fill values) where df has none."""
    values = [c for c in df.columns if c not in keys]
    hit = df.select(*(F.col(c).alias(f"_k_{c}") for c in keys), *values, F.lit(True).alias("_hit"))
    on = reduce(lambda a, b: a & b, (index[c].eqNullSafe(hit[f"_k_{c}"]) for c in keys))
    filled = (F.when(F.col("_hit").isNull(), F.lit(fill[c])).otherwise(F.col(c)).alias(c) if fill and c in fill else F.col(c) for c in values)
    return index.join(hit, on, "left").select(*keys, *filled)


def reindex_to_union(frames: Sequence[DataFrame], keys: Sequence[str], fill: Mapping | None = None) -> list[DataFrame]:
    """All frames on the union of their keys and columns."""
    index = key_union(frames, keys)
    types = {f.name: f.dataType for df in frames for f in df.schema.fields}
    whole = [df.select(*keys, *(F.col(c) if c in df.columns else F.lit((fill or {}).get(c)).cast(types[c]).alias(c) for c in types if c not in keys)) for df in frames]
    return [reindex(df, index, keys, fill) for df in whole]


def square(cells: DataFrame, row: str, column: str, value: str, fill=None) -> DataFrame:
    """Long cells with every pair of labels that occur as row or column."""
    labels = cells.select(F.col(row).alias(row)).union(cells.select(F.col(column))).distinct()
    grid = labels.crossJoin(labels.select(F.col(row).alias(column)))
    return reindex(cells.select(row, column, value), grid, [row, column], None if fill is None else {value: fill})


def product_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows for every combination of the columns' values (their distinct values, not the rows, are multiplied)."""
    grid = reduce(DataFrame.crossJoin, (df.select(c).distinct() for c in columns))
    return reindex(df, grid, columns)


def neighbourhoods(df: DataFrame, references: DataFrame, ids: Sequence[str], columns: Sequence[str], before: int = 0, after: int = 0, order: str = FRAME, end: str | None = None) -> DataFrame:
    """ids, reference_frame_index, offset and the columns, for every offset around each reference; nulls where no row is.

    Every wanted frame is a key of one equi join. With end (a column of references) the span goes from -before to the end instead.
    """
    last = F.lit(after) if end is None else (F.col(end) - F.col(order))
    wanted = references.select(*ids, F.col(order).alias("reference_frame_index"), *( [end] if end and end != order else []), F.col(order))
    wanted = wanted.withColumn("_last", last).where(F.col("_last") >= -before)
    wanted = wanted.select(*ids, "reference_frame_index", F.explode(F.sequence(F.lit(-before).cast("long"), F.col("_last").cast("long"))).alias("offset"))
    wanted = wanted.withColumn("_frame", F.col("reference_frame_index") + F.col("offset"))
    values = df.select(*(F.col(c).alias(f"_i_{c}") for c in ids), F.col(order).alias("_f"), *columns)
    on = reduce(lambda a, b: a & b, (wanted[c] == values[f"_i_{c}"] for c in ids), wanted["_frame"] == values["_f"])
    return wanted.join(values, on, "left").select(*ids, "reference_frame_index", "offset", *columns)


def missing_references(df: DataFrame, references: DataFrame, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """References that are no row of df."""
    return references.join(df.select(*ids, order), [*ids, order], "left_anti")


def subtracks(track: DataFrame, references: DataFrame, ids: Sequence[str], columns: Sequence[str], before: int = 0, after: int = 0, end: str | None = None) -> DataFrame:
    """Neighbourhoods of a track with the offset as the new frame_index."""
    return neighbourhoods(track, references, ids, columns, before, after, FRAME, end).withColumnRenamed("offset", FRAME)


def as_of(df: DataFrame, known: DataFrame, ids: Sequence[str], order: str = FRAME, direction: str = "backward", name: str = "known_index") -> DataFrame:
    """For each row the nearest known order value at or before it (backward), at or after it (forward), or the closest (the earlier of two).

    Both sides become one sequence per id, so no row is compared with more than its neighbours.
    """
    both = df.select(*ids, F.col(order).alias("_at"), F.lit(None).cast(dict(known.dtypes)[order]).alias("_known"), F.struct(*df.columns).alias("_row"))
    marks = known.select(*ids, F.col(order).alias("_at"), F.col(order).alias("_known")).distinct()
    both = both.unionByName(marks.withColumn("_row", F.lit(None).cast(both.schema["_row"].dataType)))
    w = Window.partitionBy(*ids).orderBy("_at")
    back = F.last("_known", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("_known", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.when(ahead.isNull() | (F.col("_at") - back <= ahead - F.col("_at")), back).otherwise(ahead)
    pick = {"backward": back, "forward": ahead, "closest": near}[direction]
    return both.withColumn("_pick", pick).where("_row IS NOT NULL").select("_row.*", F.col("_pick").alias(name))


def positions_in(df: DataFrame, column: str, reference: Sequence, name: str = "position") -> DataFrame:
    """The position of each value in a reference list; a value that is not there is an error."""
    at = F.array_position(F.array(*map(F.lit, reference)), F.col(column))
    return df.withColumn(name, F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("not in the reference: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))


def missing_ints(df: DataFrame, column: str) -> DataFrame:
    """Integers from the smallest to the largest value that no row has. Ranges between neighbours are expanded, not the whole span."""
    values = df.select(F.col(column).cast("long").alias("v")).where("v IS NOT NULL").distinct()
    # neighbours are found within buckets of values; the largest value of each bucket is handed to the next non-empty one
    bucket = F.floor(F.col("v") / 100_000)
    edges = values.groupBy(bucket.alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edges = edges.select("b", F.lag("hi").over(Window.orderBy("b")).alias("previous"), "lo")
    inner = values.withColumn("b", bucket).withColumn("previous", F.lag("v").over(Window.partitionBy("b").orderBy("v")))
    pairs = inner.select("previous", "v").where("previous IS NOT NULL").union(edges.select("previous", F.col("lo").alias("v")).where("previous IS NOT NULL"))
    return pairs.where("v - previous > 1").select(F.explode(F.sequence(F.col("previous") + 1, F.col("v") - 1)).alias(column))


def lookup_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys (nulls included) are keys of b."""
    return a.join(b.select(*keys).distinct().alias("b"), same(a, b, keys), "left_semi")
