"""Pose tracks in long form: ids, frame_index, keypoint_name, x, y."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME, ordered, same
from ethoframe.functions.angles import affine, polar, rotate
from ethoframe.operators.quantiles import medians, quantiles
from ethoframe.shared import materialize

KEYPOINT = "keypoint_name"


def median(column: str | Column) -> Column:
    return F.percentile(column, F.lit(0.5))


def centroids(track: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The median x and y of all keypoints of a frame."""
    return track.groupBy(*ids, FRAME).agg(median("x").alias("x"), median("y").alias("y"))


def keypoint_medians(track: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return medians(track, [*groups, KEYPOINT], ["x", "y"])


def region_of_interest(track: DataFrame, ids: Sequence[str], quantile: float = 0.99, factor: float = 1.05, size: float | None = None) -> DataFrame:
    """A square per frame around the centroid; its side is the largest, over keypoints and axes, quantile of the distance to it, times the factor, or the size given."""
    middle = centroids(track, ids).withColumnsRenamed({"x": "_cx", "y": "_cy"})
    if size is not None:
        side = F.lit(float(size))
        boxed = middle
    else:
        near = track.join(middle, [*ids, FRAME])
        away = near.select(KEYPOINT, *(F.abs(F.col(c) - F.col(f"_c{c}")).alias(c) for c in "xy"))
        spread = quantiles(away, [KEYPOINT], ["x", "y"], (quantile,)).select(*(F.col(c)[0].alias(c) for c in "xy"))
        boxed = middle.crossJoin(F.broadcast(spread.agg((F.greatest(F.max("x"), F.max("y")) * factor).alias("_side"))))
        side = F.col("_side")
    return boxed.select(*ids, FRAME, (F.col("_cx") - F.floor(side / 2)).alias("x"), (F.col("_cy") - F.floor(side / 2)).alias("y"), side.alias("w"), side.alias("h"))


def keypoint_direction(track: DataFrame, ids: Sequence[str], towards: str, start: str, degrees: bool = True) -> DataFrame:
    """rho and phi from one keypoint to another, per frame."""
    at = lambda k, c: F.max(F.when(F.col(KEYPOINT) == k, F.col(c)))
    wide = track.where(F.col(KEYPOINT).isin(towards, start)).groupBy(*ids, FRAME).agg((at(towards, "x") - at(start, "x")).alias("_dx"), (at(towards, "y") - at(start, "y")).alias("_dy"))
    p = polar(F.col("_dx"), F.col("_dy"))
    return wide.select(*ids, FRAME, p["rho"].alias("rho"), (F.degrees(p["phi"]) if degrees else p["phi"]).alias("phi"))


def norm_frames(track: DataFrame, ids: Sequence[str], towards: str, start: str | None = None, degrees: bool = True) -> DataFrame:
    """x, y and heading per frame: the centroid (or a keypoint) and the direction from it to a keypoint."""
    place = centroids(track, ids) if start is None else track.where(F.col(KEYPOINT) == start).select(*ids, FRAME, "x", "y")
    aim = track.where(F.col(KEYPOINT) == towards).select(*ids, FRAME, F.col("x").alias("_x"), F.col("y").alias("_y"))
    heading = F.atan2(F.col("_y") - F.col("y"), F.col("_x") - F.col("x"))
    return place.join(aim, [*ids, FRAME]).select(*ids, FRAME, "x", "y", (F.degrees(heading) if degrees else heading).alias("heading"))


def normalise(track: DataFrame, norm: DataFrame, keys: Sequence[str], degrees: bool = True) -> DataFrame:
    """The track moved to the norm's origin and turned against its heading; rows without a norm get null coordinates."""
    base = norm.select(*keys, F.col("x").alias("_nx"), F.col("y").alias("_ny"), F.col("heading").alias("_nh"))
    joined = track.join(base, list(keys), "left")
    turn = -(F.radians("_nh") if degrees else F.col("_nh"))
    p = rotate(F.col("x") - F.col("_nx"), F.col("y") - F.col("_ny"), turn)
    return joined.withColumn("_p", p).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "_nx", "_ny", "_nh")


def onset_norms(norm: DataFrame, onset: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """The norm of the last onset of the id for every frame."""
    w = ordered(ids, order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(onset), F.struct("x", "y", "heading")), ignorenulls=True).over(w)
    return norm.withColumn("_n", last).withColumns({c: F.col(f"_n.{c}") for c in ("x", "y", "heading")}).drop("_n")


def transform_track(track: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 2 x 3 affine matrix applied to every keypoint."""
    p = affine(F.col("x"), F.col("y"), matrix)
    return track.withColumn("_p", p).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")


def scale_for_display(points: DataFrame, target: float = 256, groups: Sequence[str] = ()) -> DataFrame:
    """Points shifted to 0, scaled so that the larger axis fits the target, and centred."""
    span = points.groupBy(*groups).agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    joined = points.join(F.broadcast(span), list(groups)) if groups else points.crossJoin(F.broadcast(span))
    widest = F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy"))
    new = lambda c: F.try_divide(F.col(c) - F.col(f"_lo{c}"), widest) * target + (target - F.try_divide(F.col(f"_hi{c}") - F.col(f"_lo{c}"), widest) * target) / 2
    return joined.withColumns({"_nx": new("x"), "_ny": new("y")}).drop("x", "y", "_lox", "_loy", "_hix", "_hiy").withColumnsRenamed({"_nx": "x", "_ny": "y"})


def trajectory_medians(trajectories: DataFrame, label: str, step: str) -> DataFrame:
    """Median keypoints and their number per label and frame of the trajectory."""
    keys = [label, step, KEYPOINT]
    rows = materialize(trajectories.select(*keys, "x", "y"), "trajectories")
    counts, middles = rows.groupBy(*keys).agg(F.count("*").alias("n")), medians(rows, keys, ["x", "y"], stored=True)
    return counts.join(middles, same(counts, middles, keys), "left").select(*(counts[k] for k in keys), "x", "y", "n")


def complete_medians(medians: DataFrame, label: str, step: str, keypoints: str = "any", steps: str = "all") -> DataFrame:
    """Whether each label has any or all keypoints, in any or all frames of the whole range of steps."""
    pick = {"any": F.bool_or, "all": F.bool_and}
    names, at = medians.select(KEYPOINT).distinct(), medians.select(step).distinct()
    grid = medians.select(label).distinct().crossJoin(at).crossJoin(names)
    seen = grid.join(medians.select(label, step, KEYPOINT, F.lit(True).alias("_seen")), [label, step, KEYPOINT], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    frames = seen.groupBy(label, step).agg(pick[keypoints](F.col("_seen")).alias("_ok"))
    return frames.groupBy(label).agg(pick[steps](F.col("_ok")).alias("complete"))


def trajectory_vectors(medians: DataFrame, label: str, step: str) -> DataFrame:
    """One vector per label: its medians in the order of step and keypoint."""
    items = F.array_sort(F.collect_list(F.struct(step, KEYPOINT, "x", "y")))
    return medians.groupBy(label).agg(F.flatten(F.transform(items, lambda p: F.array(p["x"], p["y"]))).alias("vector"))


def skeleton_edges(keypoints: DataFrame, edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, edge_index, x and y of both nodes of every edge (edge_index, node_0, node_1)."""
    end = lambda k: keypoints.select(*ids, F.col(KEYPOINT).alias(f"node_{k}"), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    return end(0).join(F.broadcast(edges), "node_0").join(end(1), [*ids, "node_1"]).select(*ids, "edge_index", "x_0", "y_0", "x_1", "y_1")


def merge_tracks(tracks: DataFrame, name: str, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tracks of one name as one: the first value that is not null, by track order, and the number of rows per frame."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("track_index")))
    return tracks.groupBy(*ids, name, FRAME).agg(F.count("*").alias("occupancy"), *(first(c).alias(c) for c in columns))


def track_validity(track: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Checks of the track schema as counts: null keys, frames out of order are impossible in a table, so repeated keys and missing coordinates remain."""
    keys = [*ids, FRAME, KEYPOINT]
    null_key = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    rows = track.agg(F.count("*").alias("rows"), F.count_if(null_key).alias("null_keys"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("half_points"))
    repeated = track.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return rows.crossJoin(repeated)


def skeleton_validity(edges: DataFrame, keypoints: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Checks of a skeleton table (ids, edge_index, node_0, node_1) per id, as counts: edges, edges without an index, repeated indices, loops, ends that are no keypoint of the id."""
    known = keypoints.select(*ids, F.col(KEYPOINT).alias("_node"), F.lit(True).alias("_known")).distinct()
    ends = edges.select(*ids, F.explode(F.array("node_0", "node_1")).alias("_node")).join(known, [*ids, "_node"], "left")
    unknown = ends.groupBy(*ids).agg(F.count_if(F.col("_known").isNull()).alias("unknown_ends"))
    counted = edges.groupBy(*ids, "edge_index").agg(F.count("*").alias("_n"), F.count_if(F.col("node_0").eqNullSafe(F.col("node_1"))).alias("_loops"))
    checks = counted.groupBy(*ids).agg(
        F.sum("_n").alias("edges"), F.sum(F.when(F.col("edge_index").isNull(), F.col("_n")).otherwise(0)).alias("null_indices"),
        F.count_if(F.col("edge_index").isNotNull() & (F.col("_n") > 1)).alias("repeated_indices"), F.sum("_loops").alias("loops"),
    )
    return checks.join(unknown, list(ids))
