"""Graphs as tables: an edge table of pairs and the nodes that they meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_edges(pairs: DataFrame, nodes: tuple[str, str], attributes: Sequence[str], order: Sequence[str], directed: bool = False) -> DataFrame:
    """node_0, node_1, the attributes: an edge a pair, with the attributes of its last row in the order given; an undirected edge starts at its smaller node.

    Pairs with a null node are no edges. The last row is an aggregate, so rows of a frequent pair are combined before the shuffle.
    """
    a, b = map(F.col, nodes)
    ends = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    last = F.max_by(F.struct(*attributes), F.struct(*order))
    edges = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(ends[0].alias("node_0"), ends[1].alias("node_1")).agg(last.alias("_last"))
    return edges.select("node_0", "node_1", "_last.*")


def graph_nodes(edges: DataFrame, weight: str) -> DataFrame:
    """node, degree, out_degree, in_degree, weight (sum over its edges): a loop counts once out and once in, so twice in the degree and once in the weight."""
    out = edges.select(F.col("node_0").alias("node"), F.lit(1).alias("_out"), F.lit(0).alias("_in"), F.col(weight).alias("_w"))
    into = edges.select("node_1", F.lit(0), F.lit(1), F.when(F.col("node_0") != F.col("node_1"), F.col(weight)))
    sums = out.union(into).groupBy("node").agg(F.sum("_out").alias("out_degree"), F.sum("_in").alias("in_degree"), F.sum("_w").alias("weight"))
    return sums.select("node", (F.col("out_degree") + F.col("in_degree")).alias("degree"), "out_degree", "in_degree", "weight")
