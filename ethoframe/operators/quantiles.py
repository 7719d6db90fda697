"""Exact quantiles of groups of any size by rank selection: histograms narrow the values down to the bins that hold the wanted ranks, and only those are sorted.

A part is what is left of a group's column. While some part has more than LIMIT rows of differing values, a mergeable sketch of bounded size gives EDGES approximate
quantiles of each part; rows are counted at and between them (summed before the shuffle), and the bins with the wanted ranks are the next parts. A bin between
two edges has about 1 / EDGES of its part's rows and a bin at an edge has one value, so a few rounds do for any size. At last the distinct values of each part are counted
and ranked. No task sees a whole group; the driver gets one number a round. Values are interpolated between neighbouring ranks.

Nulls and NaN are missing; a group without values has nulls; null is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.shared import materialize

LIMIT, EDGES, ACCURACY = 500_000, 64, 2_000
_PART = ["_g", "_c", "_part"]


def _narrowed(cells: DataFrame, wanted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The cells of parts of at most ``limit`` rows (or of one value) and the ranks wanted in them."""
    while True:
        sizes = cells.groupBy(*_PART).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # one number a round
        largest = sizes.where("_lo < _hi").agg(F.max("_n")).first()[0]
        if largest is None or largest <= limit:
            return cells, wanted
        edges = cells.groupBy(*_PART).agg(F.percentile_approx("_v", [i / EDGES for i in range(EDGES + 1)], ACCURACY).alias("_edges"))
        edges = materialize(edges, "quantile-edges")
        bin_ = 2 * F.size(F.filter("_edges", lambda e: e < F.col("_v"))) + F.array_contains("_edges", F.col("_v")).cast("int")
        binned = cells.join(edges, _PART).withColumn("_bin", bin_)
        counts = binned.groupBy(*_PART, "_bin").agg(F.count("*").alias("_k"))
        so_far = F.sum("_k").over(Window.partitionBy(*_PART).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        places = counts.withColumn("_to", so_far).withColumn("_from", F.col("_to") - F.col("_k"))
        deeper = F.concat_ws(".", "_part", "_bin")
        hit = wanted.join(places, _PART).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        wanted = materialize(hit.select("_g", "_c", deeper.alias("_part"), "_asked", (F.col("_rank") - F.col("_from")).alias("_rank")), "quantile-ranks")
        parts = wanted.select(*_PART).distinct()
        cells = materialize(binned.select("_g", "_c", deeper.alias("_part"), "_v").join(parts, _PART, "left_semi"), "quantile-cells")


def quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], at: Sequence[float] = (0.5,), limit: int = LIMIT, stored: bool = False) -> DataFrame:
    """groups and, under the name of each column, the array of its quantiles; one row for each group of df, or one row without groups.

    Every round reads the rows several times, so they are written once, unless df is a stored table already.
    """
    if not stored:
        df = materialize(df.select(*dict.fromkeys([*groups, *columns])), "quantile-rows")
    key = F.struct(*groups).alias("_g") if groups else F.struct(F.lit(0).alias("all")).alias("_g")
    items = F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))
    cells = df.select(key, F.inline(items)).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_part", F.lit(""))
    totals = cells.groupBy("_g", "_c").agg(F.count("*").alias("_total"))
    places = F.array(*(F.lit(float(q)) * (F.col("_total") - 1) for q in at))
    asked = totals.select("_g", "_c", F.posexplode(places).alias("_asked", "_place"))
    low, high = F.floor("_place"), F.ceil("_place")
    ranks = asked.select("_g", "_c", F.lit("").alias("_part"), "_asked", F.explode(F.array_distinct(F.array(low, high))).alias("_rank"))
    parts, wanted = _narrowed(cells, ranks, limit)
    counts = parts.groupBy(*_PART, "_v").agg(F.count("*").alias("_k"))
    so_far = F.sum("_k").over(Window.partitionBy(*_PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_to", so_far).withColumn("_from", F.col("_to") - F.col("_k"))
    found = wanted.join(ranked, _PART).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    ends = found.groupBy("_g", "_c", "_asked").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    value = F.when(low == high, F.col("_a")).otherwise((high - F.col("_place")) * F.col("_a") + (F.col("_place") - low) * F.col("_b"))
    values = ends.join(asked, ["_g", "_c", "_asked"]).select("_g", "_c", "_asked", value.alias("_x"))
    each = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == i, F.struct("_asked", "_x")))), lambda s: s["_x"]).alias(c) for i, c in enumerate(columns)]
    out = df.select(key).distinct() if groups else df.sparkSession.range(1).select(key)
    wide = out.join(values.groupBy("_g").agg(*each), "_g", "left")
    full = [F.when(F.size(c) > 0, F.col(c)).otherwise(F.array_repeat(F.lit(None).cast("double"), len(at))).alias(c) for c in columns]
    return wide.select(*(F.col("_g")[g].alias(g) for g in groups), *full)


def medians(df: DataFrame, groups: Sequence[str], columns: Sequence[str], limit: int = LIMIT, stored: bool = False) -> DataFrame:
    """groups and the median of each column."""
    return quantiles(df, groups, columns, (0.5,), limit, stored).select(*groups, *(F.col(c)[0].alias(c) for c in columns))
