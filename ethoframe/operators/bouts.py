"""Behaviour bouts: labels or boolean columns to bouts and back, counts, proportions, transitions and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME
from ethoframe.operators.runs import expand_limits, full_frames, run_length_encode

LABEL = "behavior_name"


def label_bouts(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME, drop_null: bool = True) -> DataFrame:
    """Bouts of a label column: ids, frame_index, end_frame, bout_length, behavior_name."""
    runs = run_length_encode(df, label, ids, order, (None,) if drop_null else ())
    return runs.select(*ids, F.col("start_index").alias(FRAME), F.col("end_index").alias("end_frame"), F.col("run_length").alias("bout_length"), F.col("run_value").alias(LABEL))


def boolean_bouts(df: DataFrame, labels: Sequence[str], ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """Bouts of boolean columns, one series per column, so rows with several true columns are in several bouts."""
    pairs = F.array(*(F.struct(F.lit(c).alias("b"), F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias("on")) for c in labels))
    long = df.select(*ids, order, F.explode(pairs).alias("p")).select(*ids, order, F.col("p.b").alias(LABEL), F.col("p.on").alias("on"))
    runs = run_length_encode(long, "on", [*ids, LABEL], order).where("run_value")
    return runs.select(*ids, F.col("start_index").alias(FRAME), F.col("end_index").alias("end_frame"), F.col("run_length").alias("bout_length"), LABEL)


def single_label(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The label whose column is true (null if none); two true columns in a row are an error."""
    on = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in labels)), lambda x: x.isNotNull())
    one = F.when(F.size(on) > 1, F.raise_error(F.lit("a row has more than one label"))).otherwise(F.get(on, F.lit(0)))
    return df.drop(*labels).withColumn(LABEL, one)


def bouts_to_behaviour(bouts: DataFrame, labels: Sequence[str], ids: Sequence[str], full_index: bool = True) -> DataFrame:
    """One boolean column per label and one row per frame; with full_index, frames outside all bouts are there, too."""
    frames = expand_limits(bouts.withColumn("_start", F.col(FRAME)).drop(FRAME), "_start", "end_frame", FRAME)
    wide = frames.groupBy(*ids, FRAME).agg(*(F.bool_or(F.col(LABEL) == b).alias(b) for b in labels))
    if full_index:
        spans = bouts.select(*ids, FRAME).unionByName(bouts.select(*ids, F.col("end_frame").alias(FRAME)))
        wide = full_frames(spans, ids).join(wide, [*ids, FRAME], "left")
    return wide.select(*ids, FRAME, *(F.coalesce(b, F.lit(False)).alias(b) for b in labels))


def bout_counts(bouts: DataFrame, ids: Sequence[str], by_length: bool = False) -> DataFrame:
    """Bouts per id and behaviour, or their frames; without ids over everything."""
    value = F.sum("bout_length") if by_length else F.count("*")
    return bouts.groupBy(*ids, LABEL).agg(value.cast("long").alias("n"))


def proportions(counts: DataFrame, ids: Sequence[str], combine: bool = False) -> DataFrame:
    """Counts over the sum of their id; with combine the ids are summed up first."""
    if combine:
        counts, ids = counts.groupBy(LABEL).agg(F.sum("n").alias("n")), ()
    total = F.sum("n").over(Window.partitionBy(*ids)) if ids else None
    if total is None:
        whole = counts.agg(F.sum("n").alias("_total"))
        return counts.crossJoin(F.broadcast(whole)).select(LABEL, F.try_divide("n", "_total").alias("proportion"))
    return counts.select(*ids, LABEL, F.try_divide("n", total).alias("proportion"))


def transitions(bouts: DataFrame, ids: Sequence[str], per_id: bool = True) -> DataFrame:
    """(ids,) previous_behavior, next_behavior, transition_count, with zero rows for all pairs of behaviours present.

    A transition needs a bout of the same id that starts at the frame after the end. Bouts of one behaviour that end at
    the same frame share their successors. The pairs of behaviours are few, the join is on (ids, frame).
    """
    keys = list(ids)
    ends = bouts.select(*keys, F.col(LABEL).alias("previous_behavior"), (F.col("end_frame") + 1).alias(FRAME)).distinct()
    starts = bouts.select(*keys, FRAME, F.col(LABEL).alias("next_behavior"))
    group = keys if per_id else []
    found = ends.join(starts, [*keys, FRAME]).groupBy(*group, "previous_behavior", "next_behavior").agg(F.count("*").alias("transition_count"))
    present = bouts.groupBy(*group).agg(F.collect_set(LABEL).alias("_labels"))
    grid = present.select(*group, "_labels", F.explode("_labels").alias("previous_behavior")).select(*group, "previous_behavior", F.explode("_labels").alias("next_behavior"))
    out = grid.join(found, [*group, "previous_behavior", "next_behavior"], "left")
    return out.select(*group, "previous_behavior", "next_behavior", F.coalesce("transition_count", F.lit(0)).cast("long").alias("transition_count"))


def behaviour_vectors(bouts: DataFrame, labels: Sequence[str], ids: Sequence[str], by_length: bool = False) -> DataFrame:
    """One row per id: transition counts as columns previous->next and behaviour counts as columns, zero where absent."""
    moves = transitions(bouts, ids).groupBy(*ids).agg(*(_sum_if("transition_count", (F.col("previous_behavior") == a) & (F.col("next_behavior") == b)).alias(f"{a}->{b}") for a in labels for b in labels))
    counts = bout_counts(bouts, ids, by_length).groupBy(*ids).agg(*(_sum_if("n", F.col(LABEL) == b).alias(b) for b in labels))
    return moves.join(counts, list(ids))


def normalised_vectors(vectors: DataFrame, labels: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Transition columns over their row's sum; a row without transitions has nulls there."""
    cells = [f"{a}->{b}" for a in labels for b in labels]
    total = sum((F.col(f"`{c}`") for c in cells[1:]), F.col(f"`{cells[0]}`"))
    return vectors.select(*ids, *(F.try_divide(F.col(f"`{c}`"), total).alias(c) for c in cells), *labels)


def _sum_if(column: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("long")


def sampled_bouts(trajectories: DataFrame, ids: Sequence[str], label: str, onset: str) -> DataFrame:
    """The bouts that sampled trajectories come from: an onset each, without end and length, which a sample doesn't know."""
    unknown = F.lit(None).cast("long")
    found = trajectories.select(*ids, F.col(onset).alias(FRAME), F.col(label).alias("behavior_name")).distinct()
    return found.select(*ids, FRAME, unknown.alias("end_frame"), unknown.alias("bout_length"), "behavior_name")
