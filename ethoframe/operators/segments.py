"""Aggregates of frames over segments by an interval index: a segment of n frames is at most 2 * log2(n) blocks whose ends are powers of two, and each block is aggregated once.

So a long segment costs a few keys of an equi join instead of a row per frame, and overlapping segments share the work. Frames are counted from 0 or above.
Segments that end before they begin, or have a null end, keep their row with nulls; frames without values count for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.frames import FRAME
from ethoframe.shared import materialize

#: Blocks of 2 ** 40 frames are beyond any recording.
LEVELS = 40


def blocks_of(start: Column, end: Column) -> Column:
    """Array of (level, block): the blocks [block * 2 ** level, (block + 1) * 2 ** level) that make up the frames from start to end."""
    past = end + 1
    # on each level, the ends rounded inwards; a block that has no partner on its side is taken there
    low = lambda k: F.ceil(start / F.pow(F.lit(2.0), k)).cast("long")
    high = lambda k: F.floor(past / F.pow(F.lit(2.0), k)).cast("long")
    block = lambda k, b: F.struct(k.cast("int").alias("level"), b.alias("block"))
    left = lambda k: F.when((low(k) < high(k)) & (low(k) % 2 == 1), F.array(block(k, low(k)))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    right = lambda k: F.when((low(k) < high(k)) & (high(k) % 2 == 1), F.array(block(k, high(k) - 1))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    levels = F.sequence(F.lit(0), F.least(F.floor(F.log2(past - start)).cast("int"), F.lit(LEVELS)))
    return F.when(past > start, F.flatten(F.transform(levels, lambda k: F.concat(left(k), right(k)))))


def segment_extremes(segments: DataFrame, frames: DataFrame, ids: Sequence[str], start: str, end: str, lows: Sequence[str], highs: Sequence[str], order: str = FRAME) -> DataFrame:
    """segments with the least of ``lows`` and the greatest of ``highs`` over the frames from start to end of the same ids, and n_frames that have values."""
    cut = materialize(segments.withColumn("_row", F.monotonically_increasing_id()).withColumn("_blocks", blocks_of(F.col(start), F.col(end))), "segments")
    keys = cut.select("_row", *ids, F.inline("_blocks"))
    levels = [r.level for r in keys.select("level").distinct().collect()]
    known = frames.where(F.greatest(*(F.col(c).isNull().cast("int") for c in (*lows, *highs))) == 0) if len([*lows, *highs]) > 1 else frames.where(F.col([*lows, *highs][0]).isNotNull())
    spread = known.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("block", F.floor(F.col(order) / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    pick = [*(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs)]
    blocks = spread.groupBy(*ids, "level", "block").agg(*pick, F.count("*").alias("n_frames"))
    found = keys.join(blocks, [*ids, "level", "block"]).groupBy("_row").agg(*pick, F.sum("n_frames").alias("n_frames"))
    return cut.drop("_blocks").join(found, "_row", "left").drop("_row").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
