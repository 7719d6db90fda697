"""Connected components of a link table: distributed union-find that moves every link to smaller roots, round by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.shared import materialize

MAX_ROUNDS = 60
#: Ids that more links than HOT name are looked up in a broadcast; so is every id if there are at most SMALL.
HOT, SMALL = 200_000, 500_000


def _looked_up(links: DataFrame, key: str, low: DataFrame, rows: int, how: str, out: list[Column]) -> DataFrame:
    """out of links (key = u or v) joined with low (id, m, n), where n links name the id; an id with many of them is never gathered."""
    on = F.col(key) == F.col("id")
    if rows <= SMALL:
        return links.join(F.broadcast(low), on, how).select(*out)
    hot = F.broadcast(low.where(F.col("n") > HOT))  # there are at most len(links) / HOT of them
    many = links.join(hot, on).select(*out)
    return many.unionByName(links.join(hot.select("id"), on, "left_anti").join(low.where(F.col("n") <= HOT), on, how).select(*out))


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of links (a, b) with the smallest id that it reaches; ids without a link are left out.

    Rounds of large-star and small-star steps: links point to the smallest neighbour until every link is one between a member and
    its root. A step looks up only the ids whose links move: in the large star those with a smaller and a larger neighbour, in the small star those with
    several smaller ones. When there are none of either, every link is settled. All of it stays
    distributed; only counts come to the driver. Null ends and self-links are dropped.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "graph-links")
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of an id goes to the smallest of the id and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count("*").alias("n"))
        middle = materialize(near.where("m < id AND most > id").select("id", "m", "n"), "graph-middle")
        moved = middle.count()
        if moved:
            edges = materialize(_looked_up(edges, "v", middle, moved, "left", [F.col("u"), F.coalesce("m", "v").alias("v")]).distinct(), "graph-large")
        # small star: every smaller neighbour of an id, and the id, go to the smallest neighbour
        least = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        several = materialize(least.where("n > 1"), "graph-several")
        split = several.count()
        if split:
            others = _looked_up(edges, "u", several, split, "inner", [F.col("v").alias("u"), F.col("m").alias("v")]).where("u <> v")
            edges = materialize(others.union(least.select(F.col("id").alias("u"), F.col("m").alias("v"))).distinct(), "graph-small")
        if not moved and not split:
            break
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", F.col("v").alias("component")).distinct())
