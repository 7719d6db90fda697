"""Rasters as rows (row, col) of set cells: predicates on grids, shifted masks, dilation and erosion."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Predicate = Callable[[Column, Column], Column]


def grid(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], step: float = 1.0) -> DataFrame:
    """Points x, y from limit to limit."""
    nx, ny = int((x[1] - x[0]) / step) + 1, int((y[1] - y[0]) / step) + 1
    return spark.range(nx * ny).select((F.col("id") % nx * step + x[0]).alias("x"), (F.floor(F.col("id") / nx) * step + y[0]).alias("y"))


def all_of(predicates: Sequence[Predicate]) -> Predicate:
    return lambda x, y: reduce(lambda a, b: a & b, (p(x, y) for p in predicates), F.lit(True))


def mark(points: DataFrame, predicates: Sequence[Predicate], name: str = "inside") -> DataFrame:
    return points.withColumn(name, all_of(predicates)(F.col("x"), F.col("y")))


def disc(center_x: float, center_y: float, radius: float) -> Predicate:
    return lambda x, y: (x - center_x) ** 2 + (y - center_y) ** 2 <= radius**2


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Predicate:
    return lambda x, y: x.between(x0, x1) & y.between(y0, y1)


#: The recording area of the depth camera, in pixels of a 512 x 424 frame.
CAGE_WALL = (84, 33, 428, 383)
CAGE_FLOOR = (114, 63, 398, 353)
FRAME_SHAPE = (424, 512)


TILE, REACH = 32, 15


def _plain(cells: DataFrame, ids: Sequence[str], grow: int, shrink: int) -> DataFrame:
    """Dilation and erosion by the copies of each cell; null coordinates equal themselves however far they are moved."""
    square = lambda reach: F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    moved = lambda df, reach: df.select(*ids, "row", "col", F.explode(square(reach)).alias("s")).select(*ids, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    grown = moved(cells, grow).distinct()
    return moved(grown, shrink).groupBy(*ids, "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == (2 * shrink + 1) ** 2).select(*ids, "row", "col")


def _tiled(cells: DataFrame, ids: Sequence[str], grow: int, shrink: int) -> DataFrame:
    """Dilation, then erosion, in tiles of 32 x 32 cells: a tile holds the cells it has and those within reach of it as one number per row, and moves them by shifting bits.

    Cells are combined before the shuffle and are sent to a second tile only within reach of its border; tile 0 is centred on the origin. No group is larger than a tile.
    """
    reach, types = grow + shrink, dict(cells.dtypes)
    first = lambda tile: F.col(tile) * TILE - TILE // 2
    tile = lambda c, by: F.floor((F.col(c).cast("long") + (by + TILE // 2)) / TILE)
    tiles_of = lambda c: F.explode(F.sequence(tile(c, -reach), tile(c, reach)))
    dealt = cells.select(*ids, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), tiles_of("row").alias("_tr")).withColumn("_tc", tiles_of("col"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("col") - first("_tc") + reach).cast("int"))
    lines = dealt.groupBy(*ids, "_tr", "_tc", "row").agg(F.bit_or(bit).alias("_m"), F.min("col").alias("_lo"), F.max("col").alias("_hi"))
    span = [F.min("row").alias("_top"), F.max("row").alias("_end"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    tiles = lines.groupBy(*ids, "_tr", "_tc").agg(F.map_from_entries(F.collect_list(F.struct("row", "_m"))).alias("_lines"), *span)

    def sideways(mask: Column, by: int, join) -> Column:
        return reduce(join, (m for k in range(1, by + 1) for m in (F.shiftleft(mask, k), F.shiftrightunsigned(mask, k))), mask)

    either, both = lambda a, b: a.bitwiseOR(b), lambda a, b: a.bitwiseAND(b)
    none = F.lit(0).cast("long")
    wide = F.transform(F.sequence(F.col("_top") - grow, F.col("_end") + grow), lambda r: reduce(either, (F.coalesce(F.try_element_at("_lines", r + k), none) for k in range(-grow, grow + 1))))
    tiles = tiles.select(*ids, "_tr", "_tc", "_top", "_lo", "_hi", F.transform(wide, lambda m: sideways(m, grow, either)).alias("_grown"))
    near = lambda i: reduce(both, (F.coalesce(F.get("_grown", i + k), none) for k in range(-shrink, shrink + 1)))
    shrunk = F.transform("_grown", lambda m, i: sideways(near(i), shrink, both)) if shrink else F.col("_grown")
    rows = tiles.select(*ids, "_tr", "_tc", "_lo", "_hi", "_top", F.posexplode(shrunk).alias("_i", "_m")).withColumn("row", F.col("_top") - grow + F.col("_i"))
    rows = rows.where((F.col("_m") != 0) & F.col("row").between(first("_tr"), first("_tr") + (TILE - 1)))
    columns = rows.withColumns({"_from": F.greatest(first("_tc"), F.col("_lo") - grow), "_to": F.least(first("_tc") + (TILE - 1), F.col("_hi") + grow)}).where("_from <= _to")
    found = columns.select(*ids, "row", "_tc", "_m", F.explode(F.sequence("_from", "_to")).alias("col"))
    found = found.where(F.call_function("shiftrightunsigned", F.col("_m"), (F.col("col") - first("_tc") + reach).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found.select(*ids, *(F.col(c).cast(types[c]).alias(c) for c in ("row", "col")))


def _morph(cells: DataFrame, ids: Sequence[str], grow: int, shrink: int) -> DataFrame:
    known = F.col("row").isNotNull() & F.col("col").isNotNull()
    if grow + shrink <= REACH:
        tiled = _tiled(cells.where(known), ids, grow, shrink)
    else:  # a large square is several smaller ones after each other
        tiled = cells.where(known).select(*ids, "row", "col")
        for way in (0, 1):
            left = (grow, shrink)[way]
            while left:
                by = min(left, REACH)
                tiled, left = _tiled(tiled, ids, *((by, 0) if way == 0 else (0, by))), left - by
    return tiled.unionByName(_plain(cells.where(~known), ids, grow, shrink))


def dilate(cells: DataFrame, ids: Sequence[str], size: int = 3) -> DataFrame:
    """Cells within a square of the size around any set cell."""
    return _morph(cells, ids, size // 2, 0)


def erode(cells: DataFrame, ids: Sequence[str], size: int = 3) -> DataFrame:
    """Cells whose whole square is set: those that every shifted copy of the mask has."""
    return _morph(cells, ids, 0, size // 2)


def clean(cells: DataFrame, ids: Sequence[str], dilation: int = 3, erosion: int = 3) -> DataFrame:
    return _morph(cells, ids, dilation // 2, erosion // 2)


def paste(mask: DataFrame, shape: tuple[int, int] = FRAME_SHAPE) -> DataFrame:
    """Mask cells (row, col, top, left) in frame coordinates, inside the frame only."""
    placed = mask.withColumns({"row": F.col("row") + F.col("top"), "col": F.col("col") + F.col("left")}).drop("top", "left")
    return placed.where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))


def _inflated_cells(text: pd.Series) -> pd.Series:
    """Positions of set cells of a raster kept as colon-separated hexadecimal bytes of deflated row-major cells."""
    return text.map(lambda t: None if t is None else np.flatnonzero(np.frombuffer(zlib.decompress(bytes(int(b, 16) for b in t.split(":"))), np.uint8)).tolist())


def raster_cells(df: DataFrame, ids: Sequence[str], text: str, width: str) -> DataFrame:
    """ids, row, col of compressed rasters."""
    cells = df.select(*ids, F.col(width).alias("_w"), F.explode(F.pandas_udf(_inflated_cells, "array<int>")(text)).alias("_p"))
    return cells.select(*ids, F.floor(F.col("_p") / F.col("_w")).cast("int").alias("row"), F.pmod("_p", "_w").cast("int").alias("col"))
