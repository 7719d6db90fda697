"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on the leading principal axes of all rows and sorted by their grid cells of side epsilon there, epsilon being
the distance of two unit vectors at the threshold's cosine. Sequence intervals of the sorted rows are the join's blocks; two blocks meet
only if their cells can lie within epsilon, and a pair of blocks is halved again and again, dropping every pair of halves whose boxes are
further apart than epsilon. What is left is compared by exact cosines in double precision.

Blocks are dealt into tiles and shuffled once; a pair of tiles is a task of a cartesian product, so disk grows with the vectors, not with the pairs.
A task returns, for each of its vectors, how many links it found and one link to the smallest vector of its local component: as many rows as
the two tiles have vectors, however dense the links. Components come from the distributed union-find.

Nulls and edges: a vector that is null, zero, empty, or holds a null or non-finite component links with nothing; vectors of different
lengths never link; copies link with each other; rows that share a vec_id are vectors of their own whose links are reported together;
a row without vec_id links with nothing; ties need no rule, as results are sets; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import materialize
from ethoframe.llm.graph import components

THRESHOLD = 0.95
AXES = 8
BLOCK_ROWS = 4096
LEAF_ROWS = 1024
#: Bytes of the blocks that a task holds while it reads those of another tile.
TILE_BYTES = 32 << 20
#: Links of pairs of blocks are joined whenever a task has so many new rows of them.
JOIN_ROWS = 1 << 18
#: Components that enter the second moments.
MOMENT_DIMS = 256
#: Added to epsilon wherever a distance only prunes, far above rounding errors.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square leaves the range of doubles."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x (bytes of the components, in the width of the input) of the rows that can link."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("embedding")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            first, values = np.asarray(lists.offsets)[:-1], lists.values.to_numpy(zero_copy_only=False)  # a null component becomes NaN
            good = np.asarray(ids.is_valid()) & (sizes > 0)
            for dim in map(int, np.unique(sizes[good])):
                at = np.flatnonzero(good & (sizes == dim))
                x = values[first[at][:, None] + np.arange(dim)].astype(np.float32 if single else np.float64)
                kept = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                packed = pa.array([v.tobytes() for v in x[kept]], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[kept])), pa.array(np.full(int(kept.sum()), dim, np.int32)), packed], ["vec_id", "dim", "x"])

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    return typed.mapInArrow(rows, "vec_id long, dim int, x binary")


def _decode(column: pa.Array, dim: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32 if width == 4 else np.float64).reshape(-1, dim)


def _axes(rows: DataFrame, dims: list[int], width: int) -> dict[int, np.ndarray]:
    """Leading principal axes for each length, from the second moments of all rows (of the first MOMENT_DIMS components)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            of = np.asarray(batch.column("dim"))
            for dim in map(int, np.unique(of)):
                x = _unit(_decode(batch.column("x").filter(pa.array(of == dim)), dim, width))[:, :MOMENT_DIMS]
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["dim", "cell", "value"])

    out = {}
    sums = rows.where(F.col("dim").isin(dims)).mapInArrow(moments, "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
    for dim in dims:
        n = min(dim, MOMENT_DIMS)
        m = np.zeros(n * n)
        for _, cell, value in sums.where(F.col("dim") == dim).collect():
            m[cell] = value
        _, vectors = np.linalg.eigh(m.reshape(n, n))
        axes = np.zeros((dim, min(AXES, n)))
        axes[:n] = vectors[:, ::-1][:, :AXES]
        out[dim] = axes
    return out


def _project(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates on the leading axes, padded with zeros; without axes, the first components (a projection as well)."""
    y = x @ axes if axes is not None else x[:, :AXES]
    return np.pad(y, ((0, 0), (0, AXES - y.shape[1])))


def _blocks(rows: DataFrame, axes: dict[int, np.ndarray], epsilon: float, width: int) -> DataFrame:
    """Sequence intervals of the grid order: block, dim, lo and hi (the box on the leading axes), ids, x."""
    cells = [f"c{i}" for i in range(AXES)]

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.asarray(batch.column("dim"))
            grid = np.zeros((batch.num_rows, AXES), np.int32)
            for dim in map(int, np.unique(of)):
                mask = of == dim
                grid[mask] = np.floor(_project(_unit(_decode(batch.column("x").filter(pa.array(mask)), dim, width)), axes.get(dim)) / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, i]) for i in range(AXES))], [*batch.schema.names, *cells])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            of = np.asarray(table["dim"])
            for dim in map(int, np.unique(of)):
                mask = pa.array(of == dim)
                x = _decode(table["x"].filter(mask).combine_chunks(), dim, width)
                y = _project(_unit(x), axes.get(dim))
                ids = np.asarray(table["vec_id"].filter(mask), dtype=np.int64)
                row = [[number], [dim], [len(ids)], [y.min(axis=0).tolist()], [y.max(axis=0).tolist()], [ids.tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)
                number += 1

        names = ["block", "dim", "rows", "lo", "hi", "ids", "x"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        waiting = 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, BLOCK_ROWS - waiting)
                held.append(batch.slice(0, take))
                batch, waiting = batch.slice(take), waiting + take
                if waiting == BLOCK_ROWS:
                    yield from flush(pa.Table.from_batches(held))
                    held, waiting = [], 0
        if waiting:
            yield from flush(pa.Table.from_batches(held))

    n = max(1, -(-rows.count() // (2 * BLOCK_ROWS)))
    grid = rows.mapInArrow(gridded, "vec_id long, dim int, x binary, " + ", ".join(f"{c} int" for c in cells))
    order = ["dim", *cells, "vec_id"]
    ranged = grid.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(packed, "block long, dim int, rows int, lo array<double>, hi array<double>, ids binary, x binary")


def _tiles(blocks: DataFrame, parallelism: int) -> DataFrame:
    """The blocks dealt into tiles of TILE_BYTES, or into more while all pairs of them leave cores idle."""
    rows, size = blocks.agg(F.count("*"), F.sum(F.octet_length("x") + F.octet_length("ids"))).first()
    return blocks.repartition(max(1, -(-(size or 0) // TILE_BYTES), min(rows, math.isqrt(4 * parallelism))))


def _pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Every pair of blocks whose boxes are within epsilon, once (a = b too), with its vectors.

    A cartesian product: each pair of partitions is a task, which reads both from the one shuffle of the blocks; no pair is written.
    Which of the two blocks is a alternates, so that all tasks get pairs.
    """
    a, b = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab")
    first, second = F.col("block_a"), F.col("block_b")
    once = (first == second) | (((first + second) % 2 == 0) == (first < second))
    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("dim_a") == F.col("dim_b")) & once & (apart <= (epsilon + SLACK) ** 2))
    return met.select("block_a", "block_b", F.col("dim_a").alias("dim"), "ids_a", "x_a", "ids_b", "x_b")


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    g = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(g @ g)


def _local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each position reaches over the links (a, b) between positions."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def _compare(xa: np.ndarray, xb: np.ndarray, ya: np.ndarray, yb: np.ndarray, same: bool, threshold: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of the links, by recursion over halves of the two intervals; i < j if both are the same block."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(xa), 0, len(xb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        if _gap(ya[a0:a1].min(axis=0), ya[a0:a1].max(axis=0), yb[b0:b1].min(axis=0), yb[b0:b1].max(axis=0)) > limit:
            continue
        if a1 - a0 > LEAF_ROWS or b1 - b0 > LEAF_ROWS:
            cut_a = [(a0, a1)] if a1 - a0 <= LEAF_ROWS else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
            cut_b = [(b0, b1)] if b1 - b0 <= LEAF_ROWS else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
            stack += [(*p, *q) for p in cut_a for q in cut_b]
            continue
        i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= threshold)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            found.append((i, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _joined(links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, n and root of several pairs of blocks as one: n added up, root the smallest vector that all of them reach together."""
    ids, n, root = (np.concatenate(c) for c in zip(*links, strict=True))
    known, at = np.unique(np.concatenate([ids, root]), return_inverse=True)
    return known, np.bincount(at[: len(ids)], n, len(known)).astype(np.int64), _local_roots(known, at[: len(ids)], at[len(ids) :])


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n (links found in one pair of tiles), root (a vector that it reaches there), for vectors with links."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = 4 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else 8
    rows = materialize(_usable_rows(vectors), "ego-rows")
    dims = [r["dim"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(4).collect()]
    axes = _axes(rows, dims, width)
    blocks = materialize(_blocks(rows, axes, epsilon, width), "ego-blocks")
    pairs = _pairs(_tiles(blocks, vectors.sparkSession.sparkContext.defaultParallelism), epsilon)
    limit = (epsilon + SLACK) ** 2

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(dim: int, ids: pa.Scalar, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            u = _unit(np.frombuffer(x.as_buffer(), np.float32 if width == 4 else np.float64).reshape(-1, dim))
            return np.frombuffer(ids.as_buffer(), np.int64).copy(), u, _project(u, axes.get(dim))

        at, held, waiting = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("block_a", "block_b", "dim", "ids_a", "x_a", "ids_b", "x_b")), strict=True):
                a, b, dim = (v.as_py() for v in row[:3])
                if a != at:  # pairs come by their first block
                    at, (ia, xa, ya) = a, side(dim, *row[3:5])
                same = a == b
                ib, xb, yb = (ia, xa, ya) if same else side(dim, *row[5:])
                i, j = _compare(xa, xb, ya, yb, same, threshold, limit)
                if not len(i):
                    continue
                ids, j = (ia, j) if same else (np.concatenate([ia, ib]), j + len(ia))
                n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                some = n > 0
                held, waiting = [*held, (ids[some], n[some], _local_roots(ids, i, j)[some])], waiting + int(some.sum())
                if waiting > JOIN_ROWS:
                    held, waiting = [_joined(held)], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(held)], ["vec_id", "n", "root"])

    return materialize(pairs.mapInArrow(compared, "vec_id long, n long, root long"), "ego-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: classes of vectors linked by cosine >= threshold."""
    found = link_counts(vectors, threshold)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    classes = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    known = counts.join(classes, "vec_id", "left")
    root = F.coalesce("component", "vec_id")
    return vectors.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept")
    )
