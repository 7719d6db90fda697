"""Assignment of several groups of objects to one anchor group, for many independent problems at once.

Each problem is one small row: an array of anchors and an array of another group's objects. Tasks take Arrow batches of such rows and solve all that have the same sizes
together: cost tensors (problems, rows, columns), and shortest augmenting paths that run in step over the problems. The matchings of one problem meet again at its anchors.

A group smaller than the anchor group leaves anchors without a partner, a larger one leaves objects out. Objects with a null key or vector are left out; problems
without anchors have no rows. Of equal totals one is taken, the same each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of one cost tensor.
TENSOR = 4_000_000


def match_batch(costs: np.ndarray) -> np.ndarray:
    """(problems, rows): the column of each row in the assignment of least total cost; rows must not outnumber columns.

    Rows join one after the other. From each new row all problems extend a tree of shortest reduced paths, a column at a time, until they reach a free column.
    """
    b, n, m = costs.shape
    every = np.arange(b)
    u, v = np.zeros((b, n + 1)), np.zeros((b, m + 1))
    owner = np.zeros((b, m + 1), np.int64)  # row of each column, from 1; column 0 holds the joining row
    for row in range(1, n + 1):
        owner[:, 0] = row
        at = np.zeros(b, np.int64)
        least, came, done = np.full((b, m + 1), np.inf), np.zeros((b, m + 1), np.int64), np.zeros((b, m + 1), bool)
        open_ = every
        while len(open_):
            done[open_, at[open_]] = True
            r = owner[open_, at[open_]]
            reduced = costs[open_, r - 1] - u[open_, r][:, None] - v[open_, 1:]
            better = ~done[open_, 1:] & (reduced < least[open_, 1:])
            least[open_, 1:] = np.where(better, reduced, least[open_, 1:])
            came[open_, 1:] = np.where(better, at[open_][:, None], came[open_, 1:])
            reach = np.where(done[open_], np.inf, least[open_])
            reach[:, 0] = np.inf
            to = reach.argmin(axis=1)
            step = reach[np.arange(len(open_)), to][:, None]
            inside = done[open_]
            np.add.at(u, (np.repeat(open_, m + 1), owner[open_].ravel()), np.where(inside, step, 0).ravel())
            v[open_] -= np.where(inside, step, 0)
            least[open_] -= np.where(inside, 0, step)
            at[open_] = to
            open_ = open_[owner[open_, to] > 0]
        open_ = every
        while len(open_):  # shift owners along the path back to the joining row
            back = came[open_, at[open_]]
            owner[open_, at[open_]] = owner[open_, back]
            at[open_] = back
            open_ = open_[back > 0]
    out = np.zeros((b, n + 1), np.int64)
    np.put_along_axis(out, owner[:, 1:], np.arange(1, m + 1)[None, :].repeat(b, 0), axis=1)
    return out[:, 1:] - 1


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(problems, anchors, objects) of vectors (problems, objects, components)."""
    if metric == "mse":
        return np.square(a[:, :, None, :] - b[:, None, :, :]).mean(axis=3)
    if metric == "euclidean":
        return np.sqrt(np.square(a[:, :, None, :] - b[:, None, :, :]).sum(axis=3))
    raise ValueError(f"unknown metric {metric}")


def _solved(a: np.ndarray, b: np.ndarray, metric: str, maximize: bool) -> tuple[np.ndarray, np.ndarray]:
    """(partner of each anchor or -1, cost) for problems of equal sizes."""
    costs = _distances(a, b, metric)
    signed = -costs if maximize else costs
    n, m = costs.shape[1:]
    if n <= m:
        partner = match_batch(signed)
    else:
        partner = np.full(costs.shape[:2], -1)
        np.put_along_axis(partner, match_batch(signed.transpose(0, 2, 1)), np.arange(m)[None, :].repeat(len(a), 0), axis=1)
    cost = np.take_along_axis(costs, np.maximum(partner, 0)[:, :, None], axis=2)[:, :, 0]
    return partner, np.where(partner < 0, np.nan, cost)


def _cut(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list array."""
    return np.diff(array.offsets.to_numpy()), array.flatten()


def assign_to_anchor(objects: DataFrame, problem: Sequence[str], group: str, anchor: Column, item: str, vector: str, metric: str = "mse", maximize: bool = False) -> DataFrame:
    """problem, anchor, group, partner, cost: for each other group, the object that the least (or largest) total of distances gives to each anchor; null where none is left.

    objects has a row per object; rows where ``anchor`` is true are the anchors. All vectors have the same length.
    """
    known = objects.where(F.col(item).isNotNull() & F.col(vector).isNotNull())
    packed = F.array_sort(F.collect_list(F.struct(F.col(item).alias("k"), F.col(vector).cast("array<double>").alias("v"))))
    anchors = known.where(anchor).groupBy(*problem).agg(packed.alias("_a"))
    others = known.where(~anchor & F.col(group).isNotNull()).groupBy(*problem, group).agg(packed.alias("_b"))
    keys = lambda c: F.transform(c, lambda x: x["k"])
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["v"]))
    rows = others.join(anchors, list(problem)).select(*problem, group, keys("_a").alias("_ka"), flat("_a").alias("_va"), keys("_b").alias("_kb"), flat("_b").alias("_vb"))
    schema = T.StructType([*rows.select(*problem, group, "_ka", "_kb").schema.fields, T.StructField("_to", T.ArrayType(T.IntegerType())), T.StructField("_cost", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (na, va), (nb, vb) = _cut(batch.column("_va")), _cut(batch.column("_vb"))
            va, vb = va.to_numpy(zero_copy_only=False), vb.to_numpy(zero_copy_only=False)
            ka, kb = _cut(batch.column("_ka"))[0], _cut(batch.column("_kb"))[0]
            at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
            to, cost = [None] * batch.num_rows, [None] * batch.num_rows
            sizes = np.stack([ka, kb, na, nb])
            for n, m, size_a, size_b in np.unique(sizes, axis=1).T:
                same = np.flatnonzero((sizes.T == (n, m, size_a, size_b)).all(axis=1))
                for part in np.array_split(same, max(1, int(len(same) * n * m * max(1, size_a // n) // TENSOR))):
                    a = va[at_a[part][:, None] + np.arange(size_a)].reshape(len(part), n, -1)
                    b = vb[at_b[part][:, None] + np.arange(size_b)].reshape(len(part), m, -1)
                    partner, distance = _solved(a, b, metric, maximize)
                    for i, p, d in zip(part.tolist(), partner.tolist(), distance.tolist(), strict=True):
                        to[i], cost[i] = p, d
            columns = [batch.column(c) for c in (*problem, group, "_ka", "_kb")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(to, pa.list_(pa.int32())), pa.array(cost, pa.list_(pa.float64()))], schema.names)

    solved = rows.mapInArrow(solve, schema)
    each = solved.select(*problem, group, "_kb", F.posexplode("_ka").alias("_i", "anchor"), "_to", "_cost")
    place = F.get("_to", F.col("_i"))
    return each.select(*problem, "anchor", group, F.when(place >= 0, F.get("_kb", place)).alias("partner"), F.when(place >= 0, F.get("_cost", F.col("_i"))).alias("cost"))


def aligned_groups(assigned: DataFrame, problem: Sequence[str], group: str) -> DataFrame:
    """problem, anchor, partners: the composition of all matchings along the anchors, as a map from group to partner."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("partner").alias("p"))))
    return assigned.groupBy(*problem, "anchor").agg(F.map_from_entries(entries).alias("partners"))
