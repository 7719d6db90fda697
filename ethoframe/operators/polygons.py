"""Polygons as intervals of raster columns: scanlines cut each polygon where an edge crosses a row, so the work grows with the border and not with the area.

A cell (row, col) is inside by the even-odd rule at its own coordinates; an edge counts for the rows from its upper end up to, and without, its lower end.
Null points and polygons of fewer than three points have no cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Crossings of edges and raster rows that a task holds at once.
CROSSINGS = 1_000_000


def _crossings(ax, ay, bx, by, of, n, clip):
    """(polygon, row, col_from, col_to) arrays of n polygons whose edges (a, b) belong to polygon ``of``, at most about CROSSINGS crossings at a time."""
    up = (ay <= by) | np.isnan(by)  # NaN is the largest number, as in Spark
    px, py, qx, qy = np.where(up, ax, bx), np.where(up, ay, by), np.where(up, bx, ax), np.where(up, by, ay)
    whole = lambda y: np.clip(np.nan_to_num(np.ceil(y), nan=0.0, posinf=2.0**62, neginf=-(2.0**62)), -(2.0**62), 2.0**62).astype(np.int64)
    first, last = whole(py), whole(qy) - 1
    if clip is not None:
        first, last = np.maximum(first, 0), np.minimum(last, clip[0] - 1)
    used = first <= last
    px, py, qx, qy, of, first, last = (v[used] for v in (px, py, qx, qy, of, first, last))
    total = np.concatenate([[0], np.cumsum(np.bincount(of, last - first + 1.0, minlength=n))])
    edges = np.searchsorted(of, np.arange(n + 1))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + CROSSINGS, side="right")) - 1)
        e = slice(edges[at], edges[end])
        at = end
        if e.start == e.stop:
            continue
        low, high = int(first[e].min()), int(last[e].max())
        if high - low >= 2**31:
            raise ValueError("a polygon without limits has too many rows")
        # a polygon with more crossings is cut by rows
        step = high - low + 1 if total[end] - total[end - 1] <= CROSSINGS else max(1, CROSSINGS // (e.stop - e.start))
        for top in range(low, high + 1, step):
            lo, hi = np.maximum(first[e], top), np.minimum(last[e], top + step - 1)
            k = np.maximum(hi - lo + 1, 0)
            i = np.repeat(np.arange(e.start, e.stop), k)
            row = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
            with np.errstate(invalid="ignore", over="ignore"):
                x = px[i] + (row - py[i]) * (qx[i] - px[i]) / (qy[i] - py[i])
            order = np.lexsort((x, row, of[i]))
            x, row, polygon = x[order], row[order], of[i][order]
            begins = np.concatenate([[True], (row[1:] != row[:-1]) | (polygon[1:] != polygon[:-1])])[: len(x)]
            place = np.arange(len(x)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            left = np.flatnonzero((place % 2 == 0)[:-1] & ~begins[1:])
            col_from, col_to = whole(x[left]), whole(x[left + 1]) - 1
            if clip is not None:
                col_from, col_to = np.maximum(col_from, 0), np.minimum(col_to, clip[1] - 1)
            kept = col_from <= col_to
            yield polygon[left][kept], row[left][kept], col_from[kept], col_to[kept]


def scanline_rows(df: DataFrame, ids: Sequence[str], points: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """ids, row, spans (array of (col_from, col_to), ascending): the cells inside each polygon (array of (x, y)) as closed intervals, clipped to rows and columns of shape.

    Every row of df is a polygon of its own and is worked on where it lies: nothing is shuffled, gathered or sorted over polygons.
    """
    ring = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    axis = lambda c: F.transform("_ring", lambda p: p[c].cast("double")).alias(f"_{c}")
    rings = df.select(*ids, ring.alias("_ring")).where(F.size("_ring") >= 3).select(*ids, axis("x"), axis("y"))
    span = T.StructType([T.StructField("col_from", T.LongType()), T.StructField("col_to", T.LongType())])
    schema = T.StructType([*rings.select(*ids).schema.fields, T.StructField("row", T.LongType()), T.StructField("spans", T.ArrayType(span))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("_x"), batch.column("_y")
            size = np.asarray(pc.list_value_length(x), dtype=np.int64)
            x, y = (np.asarray(v.flatten(), dtype=np.float64) for v in (x, y))
            start = np.cumsum(size) - size
            following = np.arange(1, len(x) + 1)
            following[start + size - 1] = start
            for polygon, row, col_from, col_to in _crossings(x, y, x[following], y[following], np.repeat(np.arange(len(size)), size), len(size), shape):
                if not len(row):
                    continue
                begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (polygon[1:] != polygon[:-1])]))
                values = pa.StructArray.from_arrays([pa.array(col_from), pa.array(col_to)], ["col_from", "col_to"])
                spans = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)), pa.int32()), values)
                keys = [batch.column(c).take(pa.array(polygon[begins])) for c in ids]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(row[begins]), spans], schema.names)

    return rings.mapInArrow(cut, schema)


def scanline_intervals(df: DataFrame, ids: Sequence[str], points: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """ids, row, col_from, col_to: scanline_rows(), an interval a row."""
    return scanline_rows(df, ids, points, shape).select(*ids, "row", F.inline("spans"))


def span_cells(spans: Column) -> Column:
    """The columns of a row's spans as one array, ascending."""
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["col_from"], s["col_to"])))


def interval_cells(spans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, row, col of all cells of intervals."""
    return spans.select(*ids, "row", F.explode(F.sequence("col_from", "col_to")).alias("col"))


def interval_areas(spans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, n_cells and centre (row, col) of each mask, without listing its cells."""
    n = F.col("col_to") - F.col("col_from") + 1
    sums = spans.groupBy(*ids).agg(F.sum(n).alias("n_cells"), F.sum(n * F.col("row")).alias("_r"), F.sum(n * (F.col("col_from") + F.col("col_to")) / 2).alias("_c"))
    return sums.select(*ids, "n_cells", (F.col("_r") / F.col("n_cells")).alias("row"), (F.col("_c") / F.col("n_cells")).alias("col"))


def combine_intervals(spans: DataFrame, ids: Sequence[str], masks: str, least: int) -> DataFrame:
    """ids, row, col_from, col_to where at least ``least`` of the masks (column ``masks``; intervals of one mask don't overlap) cover a cell: 1 is union, their number intersection."""
    from pyspark.sql.window import Window

    edge = F.array(F.struct(F.col("col_from").alias("at"), F.lit(1).alias("step")), F.struct((F.col("col_to") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = spans.select(*ids, "row", masks, F.inline(edge)).groupBy(*ids, "row", "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*ids, "row").orderBy("at")
    depth = steps.withColumns({"depth": F.sum("step").over(w), "next": F.lead("at").over(w)}).where((F.col("depth") >= least) & F.col("next").isNotNull())
    # neighbouring stretches become one
    starts = depth.withColumn("_new", F.when(F.lag("next").over(w) == F.col("at"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return starts.groupBy(*ids, "row", "_run").agg(F.min("at").alias("col_from"), (F.max("next") - 1).alias("col_to")).drop("_run")


def box_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
