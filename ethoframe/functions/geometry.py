"""Boxes struct(x, y, w, h), polygons array<struct<x, y>> and points as column expressions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ethoframe.functions.angles import affine
from ethoframe.shared import materialize


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def corners_to_box(b: Column) -> Column:
    """struct(x1, y1, x2, y2) as a box."""
    return box(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def box_to_corners(b: Column) -> Column:
    return F.struct(b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether boxes share an area; touching edges do not count."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def box_intersection(a: Column, b: Column) -> Column:
    """The shared box, null without one."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right, top = F.least(a["x"] + a["w"], b["x"] + b["w"]), F.least(a["y"] + a["h"], b["y"] + b["h"])
    return F.when(boxes_overlap(a, b), box(x, y, right - x, top - y))


def in_box(x: Column, y: Column, b: Column) -> Column:
    """Whether the point lies in the box, edges included."""
    return x.between(b["x"], b["x"] + b["w"]) & y.between(b["y"], b["y"] + b["h"])


def scale_box(b: Column, x_factor: float = 1, y_factor: float = 1, x_pad: float = 0, y_pad: float = 0) -> Column:
    """The box scaled about its centre, then padded on every side."""
    w, h = b["w"] * x_factor + 2 * x_pad, b["h"] * y_factor + 2 * y_pad
    return box(b["x"] + b["w"] / 2 - w / 2, b["y"] + b["h"] / 2 - h / 2, w, h)


def clip_box(b: Column, limits: Column, error: bool = True) -> Column:
    """The part of the box within limits; a box outside is an error, or null."""
    outside = F.raise_error(F.lit("the box lies outside the limits")).cast(_BOX) if error else F.lit(None).cast(_BOX)
    return F.coalesce(box_intersection(b, limits).cast(_BOX), outside)


_BOX = "struct<x: double, y: double, w: double, h: double>"


def frame_box(width: float, height: float) -> Column:
    return box(F.lit(0.0), F.lit(0.0), F.lit(float(width)), F.lit(float(height)))


def union_box(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return box(x, y, F.max(b["x"] + b["w"]) - x, F.max(b["y"] + b["h"]) - y)


def points_box(x: Column, y: Column) -> Column:
    """Aggregate: the box around all points of a group."""
    return box(F.min(x), F.min(y), F.max(x) - F.min(x), F.max(y) - F.min(y))


def rotated_corners(x: Column, y: Column, direction: Column, half_long: Column, half_wide: Column) -> Column:
    """The four corners of a box turned by direction (radians) around its centre."""
    cos, sin = F.cos(direction), F.sin(direction)
    corner = lambda i, j: F.struct((x + i * half_long * cos - j * half_wide * sin).alias("x"), (y + i * half_long * sin + j * half_wide * cos).alias("y"))
    return F.array(*(corner(F.lit(i), F.lit(j)) for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))))


def polygon_box(polygon: Column) -> Column:
    """The box around a polygon or any array of points."""
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return box(F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))


def box_polygon(b: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(b["x"], b["y"]), point(b["x"] + b["w"], b["y"]), point(b["x"] + b["w"], b["y"] + b["h"]), point(b["x"], b["y"] + b["h"]))


def circle_polygon(x: Column, y: Column, radius: Column, points: int = 64) -> Column:
    """A regular polygon on the circle."""
    at = [2 * math.pi * i / points for i in range(points)]
    return F.array(*(F.struct((x + radius * math.cos(a)).alias("x"), (y + radius * math.sin(a)).alias("y")) for a in at))


def _edges(polygon: Column) -> Column:
    """struct(a, b) for each side."""
    shifted = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a ray from the point crosses the sides an odd number of times."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cut = a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < cut)

    return F.size(F.filter(_edges(polygon), crossed)) % 2 == 1


def polygon_area(polygon: Column) -> Column:
    """Signed area by the shoelace formula."""
    return F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def polygon_centroid(polygon: Column) -> Column:
    """struct(x, y) of the centroid; null for a polygon without area."""

    def along(axis: str) -> Column:
        moment = F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
        return F.try_divide(moment, 6 * polygon_area(polygon))

    return F.struct(along("x").alias("x"), along("y").alias("y"))


def polygon_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance of a point to the nearest side; 0 inside."""

    def to_side(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.when(in_polygon(x, y, polygon), F.lit(0.0)).otherwise(F.array_min(F.transform(_edges(polygon), to_side)))


def perspective(x: Column, y: Column, m: list[list[float]]) -> Column:
    """struct(x, y) under a 3 x 3 perspective matrix."""
    w = x * m[2][0] + y * m[2][1] + m[2][2]
    return F.struct(F.try_divide(x * m[0][0] + y * m[0][1] + m[0][2], w).alias("x"), F.try_divide(x * m[1][0] + y * m[1][1] + m[1][2], w).alias("y"))


def transform_box(b: Column, matrix: list[list[float]]) -> Column:
    """The box whose corner is transformed as a point and whose size as a vector."""
    corner, size = affine(b["x"], b["y"], matrix), affine(b["w"], b["h"], [[*matrix[0][:2], 0.0], [*matrix[1][:2], 0.0]])
    return box(corner["x"], corner["y"], size["x"], size["y"])


def label_points(points: DataFrame, areas: DataFrame, n_areas: int, mode: str = "first", outside: str = "null") -> DataFrame:
    """points (x, y, ...) with area: the first matching area by name, or all of them (mode="all": an array).

    areas has name and polygon. outside: "null", "closest" (the nearest area) or "raise". The areas are few and enter as one broadcast array per row.
    """
    if n_areas > 10_000:
        raise ValueError("more areas than a broadcast array should hold; tile the plane and join on tiles")
    gathered = areas.agg(F.array_sort(F.collect_list(F.struct("name", "polygon"))).alias("_areas"))
    joined = points.crossJoin(F.broadcast(gathered))
    inside = F.filter("_areas", lambda a: in_polygon(F.col("x"), F.col("y"), a["polygon"]))
    names = F.transform(inside, lambda a: a["name"])
    if mode == "all":
        return joined.withColumn("area", names).drop("_areas")
    nearest = F.array_min(F.transform("_areas", lambda a: F.struct(polygon_distance(F.col("x"), F.col("y"), a["polygon"]).alias("d"), a["name"].alias("name"))))["name"]
    other = {"null": F.lit(None).cast("string"), "closest": nearest, "raise": F.raise_error(F.lit("a point lies in no area")).cast("string")}[outside]
    return joined.withColumn("area", F.coalesce(F.get(names, F.lit(0)), other)).drop("_areas")


#: A group of more boxes is merged by joins.
GROUP = 512
#: Pairs of boxes that a task holds at once.
PAIRS = 2_000_000


def _merged(group: np.ndarray, boxes: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, boxes): the distinct boxes of each group (ascending), overlapping ones replaced by their union round by round, all groups at once."""
    done = []
    for _ in range(rounds):
        order = np.lexsort((*boxes.T[::-1], group))
        group, boxes = group[order], boxes[order]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (boxes[1:] != boxes[:-1]).any(axis=1)])
        group, boxes = group[fresh], boxes[fresh]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        mates = np.repeat(size, size)
        own = np.repeat(np.arange(len(group)), mates)
        other = np.arange(len(own)) - np.repeat(np.cumsum(mates) - mates, mates) + np.repeat(np.repeat(first, size), mates)
        x, y, w, h = boxes.T
        right, top = x + w, y + h
        met = (own == other) | ((x[own] < right[other]) & (x[other] < right[own]) & (y[own] < top[other]) & (y[other] < top[own]))
        own, other = own[met], other[met]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        x, y = np.minimum.reduceat(x[other], starts), np.minimum.reduceat(y[other], starts)
        grown = np.stack([x, y, np.maximum.reduceat(right[other], starts) - x, np.maximum.reduceat(top[other], starts) - y], axis=1)
        open_ = np.repeat(np.logical_or.reduceat((grown != boxes).any(axis=1), first), size)
        done.append((group[~open_], boxes[~open_]))
        group, boxes = group[open_], grown[open_]
        if not len(group):
            group, boxes = (np.concatenate(v) for v in zip(*done, strict=True))
            order = np.argsort(group, kind="stable")
            return group[order], boxes[order]
    raise RuntimeError(f"boxes still overlap after {rounds} rounds")


def merge_boxes(boxes: DataFrame, ids: list[str], rounds: int = 20) -> DataFrame:
    """Boxes per id (columns of ids, box), overlapping ones replaced by their union until none overlap.

    Each round groups the boxes that overlap within the id; it ends when a round changes nothing. Boxes are dealt by id once, and tasks merge the ids that have at most GROUP rows,
    many of them at a time. Ids with more, or with a null or NaN in a box, pass through to _joined(), which holds no id at once.
    """
    plain = boxes.select(*ids, F.col("box").cast(_BOX).alias("box"))
    if not ids:
        return _joined(plain, ids, rounds)
    place = F.row_number().over(Window.partitionBy(*ids).orderBy("box"))
    dealt = plain.withColumn("_place", place).select(*ids, *(F.col(f"box.{c}").alias(f"_{c}") for c in "xywh"), "_place")
    schema = T.StructType([*dealt.drop("_place").schema.fields, T.StructField("_open", T.BooleanType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            place = np.asarray(rows["_place"])
            first = np.flatnonzero(place == 1)
            group = np.cumsum(place == 1) - 1
            size = np.diff(np.append(first, len(place)))
            values = np.stack([np.asarray(rows[f"_{c}"].cast(pa.float64()).fill_null(np.nan)) for c in "xywh"], axis=1)
            apart = (size > GROUP) | np.logical_or.reduceat(np.isnan(values).any(axis=1), first)
            passed = rows.filter(pa.array(apart[group])).drop_columns("_place")
            yield from passed.append_column("_open", pa.array(np.ones(passed.num_rows, bool))).to_batches()
            small = ~apart[group]
            if small.any():
                at, found = _merged(group[small], values[small], rounds)
                keys = [rows[c].take(pa.array(first[at])) for c in ids]
                yield from pa.table([*keys, *(pa.array(v) for v in found.T), pa.array(np.zeros(len(at), bool))], names=schema.names).to_batches()

        # held: rows from a first row of an id on; a long id is let go in pieces, whose later ones have no first row
        held, rows, long_ = [], 0, False

        def passing(part: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from part.drop_columns("_place").append_column("_open", pa.array(np.ones(part.num_rows, bool))).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = np.flatnonzero(np.asarray(batch.column("_place")) == 1)
            if long_:
                end = int(starts[0]) if len(starts) else table.num_rows
                yield from passing(table.slice(0, end))
                table, starts = table.slice(end), starts - end
                long_ = not len(starts)
            if not table.num_rows:
                continue
            if len(starts):
                cut = int(starts[-1])
                whole = pa.concat_tables([*held, table.slice(0, cut)]) if held or cut else None
                if whole is not None:
                    firsts = np.append(np.flatnonzero(np.asarray(whole["_place"]) == 1), whole.num_rows)
                    pairs = np.cumsum(np.minimum(np.diff(firsts), GROUP) ** 2)
                    a = 0
                    while a < len(pairs):
                        b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, side="right")))
                        yield from merged(whole.slice(int(firsts[a]), int(firsts[b] - firsts[a])))
                        a = b
                held, rows = [table.slice(cut)], table.num_rows - cut
            else:
                held, rows = [*held, table], rows + table.num_rows
            if rows > GROUP:
                for part in held:
                    yield from passing(part)
                held, rows, long_ = [], 0, True
        if held:
            yield from merged(pa.concat_tables(held))

    found = materialize(dealt.mapInArrow(merge, schema), "boxes-merged")
    back = lambda rows: rows.select(*ids, F.struct(*(F.col(f"_{c}").alias(c) for c in "xywh")).cast(_BOX).alias("box"))
    apart = found.where("_open")
    closed = back(found.where("NOT _open"))
    if not apart.limit(1).count():
        return closed
    return closed.unionByName(_joined(back(apart), ids, rounds))


def _joined(boxes: DataFrame, ids: list[str], rounds: int) -> DataFrame:
    """merge_boxes() with a join of all boxes of an id a round."""
    current = boxes.distinct()
    for _ in range(rounds):
        a, b = current.alias("a"), current.alias("b")
        same_id = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids]
        met = boxes_overlap(F.col("a.box"), F.col("b.box")) | (F.col("a.box") == F.col("b.box"))
        on = met
        for c in same_id:
            on = on & c
        grown = a.join(b, on).groupBy(*(F.col(f"a.{c}").alias(c) for c in ids), F.col("a.box").alias("_own")).agg(union_box(F.col("b.box")).cast(_BOX).alias("box"))
        changed = grown.where("_own <> box").limit(1).count()
        current = grown.select(*ids, "box").distinct()
        if not changed:
            return current
        current = materialize(current, "boxes")
    raise RuntimeError(f"boxes still overlap after {rounds} rounds")
