"""Complete-linkage clustering as rounds of a distance table.

In each round every cluster names its nearest one, and all pairs that name each other merge at once: such pairs merge in any order of an agglomeration by greatest distance,
as the distance to a merged cluster is never less than to its parts. Distances of equal size are ordered by the clusters' names, so there always is such a pair.
The distances of the merged clusters are one aggregate. A table of n clusters has n * (n - 1) / 2 rows and shrinks in each round; all rounds are plans over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoframe.shared import materialize


def complete_linkage(distances: DataFrame, a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """left, right, height, size: the merges of a table of distances (a < b once each). A cluster is named by its smallest member; left < right.

    Pairs without a distance, or with null, are left out of the maxima; clusters without any distance to each other stay apart.
    """
    pairs = distances.where(F.col(distance).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(distance).cast("double").alias("d")).where("a <> b")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("d").alias("d")), "linkage-pairs")
    members = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("cluster"), F.lit(1).cast("long").alias("size"))
    members, merges = materialize(members, "linkage-members"), []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        order = F.struct("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        near = both.groupBy("a").agg(F.min(order).alias("n"))
        chosen = near.select(F.col("n.x").alias("left"), F.col("n.y").alias("right"), F.col("n.d").alias("height")).groupBy("left", "right", "height").agg(F.count("*").alias("k"))
        chosen = materialize(chosen.where("k = 2").drop("k"), "linkage-chosen")
        sizes = members.select(F.col("cluster").alias("left"), F.col("size").alias("_l")), members.select(F.col("cluster").alias("right"), F.col("size").alias("_r"))
        merges.append(chosen.join(sizes[0], "left").join(sizes[1], "right").select("left", "right", "height", (F.col("_l") + F.col("_r")).alias("size")))
        into = chosen.select(F.col("right").alias("old"), F.col("left").alias("new"))
        renamed = lambda df, c: df.join(into, df[c] == into["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")  # noqa: E731, B023
        members = materialize(renamed(members, "cluster").groupBy("cluster").agg(F.sum("size").alias("size")), "linkage-members")
        moved = renamed(renamed(pairs, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
        pairs = materialize(moved.groupBy("a", "b").agg(F.max("d").alias("d")), "linkage-pairs")
    if not merges:
        return distances.sparkSession.createDataFrame([], distances.select(F.col(a).alias("left"), F.col(b).alias("right"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size")).schema)
    return reduce(DataFrame.unionByName, merges)
