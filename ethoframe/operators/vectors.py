"""Vectors per sample: group medians, pairwise distances, centroid classification, silhouettes and assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ethoframe.functions.arrays import cosine_distance, euclidean_distance
from ethoframe.operators.quantiles import medians
from ethoframe.shared import materialize

METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def group_sizes(df: DataFrame, groups: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """Distinct samples per group."""
    return df.select(*groups, *samples).distinct().groupBy(*groups).agg(F.count("*").alias("n"))


def group_aggregate(df: DataFrame, groups: Sequence[str], columns: Sequence[str], stat: str = "median", small: bool = False) -> DataFrame:
    """Statistics of each group. With small, each group's values surely fit into a task, and the median is one aggregate."""
    if stat == "median" and not small:
        return medians(df, groups, columns)
    pick = {"median": lambda c: F.percentile(c, F.lit(0.5)), "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}[stat]
    return df.groupBy(*groups).agg(*(pick(F.col(c)).alias(c) for c in columns))


def vector_medians(df: DataFrame, vector: str, groups: Sequence[str], name: str = "centroid") -> DataFrame:
    """The coordinate-wise median of each group. Coordinates are rows, and a group is never gathered."""
    middle = medians(df.select(*groups, F.posexplode(vector).alias("_i", "_m")), [*groups, "_i"], ["_m"])
    items = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return middle.groupBy(*groups).agg(F.transform(items, lambda x: x["_m"]).alias(name))


def glass_delta(df: DataFrame, value: str, is_test: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(mean of test - mean of control) / standard deviation of control."""
    test, control = F.when(is_test, F.col(value)), F.when(~is_test, F.col(value))
    return df.groupBy(*groups).agg(F.try_divide(F.avg(test) - F.avg(control), F.stddev_samp(control)).alias("glass_delta"))


def pairwise_distances(a: DataFrame, b: DataFrame, key: str, vector: str, metric: str = "cosine", ordered_pairs: bool = False) -> DataFrame:
    """key_a, key_b, distance of all rows of a and b (with ordered_pairs: key_a < key_b only). All pairs is what is asked for; keep one side small."""
    left = a.select(F.col(key).alias("key_a"), F.col(vector).alias("_a"))
    right = b.select(F.col(key).alias("key_b"), F.col(vector).alias("_b"))
    pairs = left.crossJoin(right)
    if ordered_pairs:
        pairs = pairs.where("key_a < key_b")
    return pairs.select("key_a", "key_b", METRICS[metric](F.col("_a"), F.col("_b")).alias("distance"))


def distances_by_group(distances: DataFrame, groups: DataFrame, key: str, group: str, stat: str = "median") -> DataFrame:
    """Per row key, the distances to each group of column keys, aggregated."""
    named = distances.join(groups.select(F.col(key).alias("key_b"), F.col(group)), "key_b")
    return group_aggregate(named, ["key_a", group], ["distance"], stat, small=True)


def distances_to_groups(df: DataFrame, key: str, vector: str, group: str, block: int = 4_096, cells: int = 4_000_000) -> DataFrame:
    """key_a, group, distance: the median cosine distance of each key's rows to all rows of each group, null if none has one.

    All pairs are compared, as exact medians need, but none is a row: rows are dealt to blocks by their key, and a task multiplies the matrices of a block and a group, some
    rows at a time (at most ``cells`` distances, or those of one key). It holds a group's vectors; they are shuffled once for each block. Vectors without a length, with nulls or
    of another size have no distance.
    """
    import numpy as np
    import pyarrow as pa

    rows = df.select(F.col(key).alias("key_a"), F.col(group), F.col(vector).cast("array<double>" if dict(df.dtypes)[vector] != "array<float>" else "array<float>").alias("_v"))
    blocks = max(1, -(-rows.count() // block))
    left = rows.select("key_a", "_v", F.pmod(F.xxhash64("key_a"), F.lit(blocks)).cast("int").alias("_b")).crossJoin(rows.select(group).distinct())
    right = rows.select(F.col(group).alias("_h"), F.col("_v").alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_c"))

    def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By size of the vectors: their places and themselves, over their lengths."""
        lists = column.combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values
        bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
        sizes, out = np.diff(offsets), {}
        for size in set(sizes[whole].tolist()) - {0}:
            places = np.flatnonzero(whole & (sizes == size))
            m = values[offsets[places][:, None] + np.arange(size)]
            with np.errstate(all="ignore"):
                length = np.sqrt((m * m).sum(1))
                keep = length != 0
                out[size] = places[keep], m[keep] / length[keep, None]
        return out

    def middle(d: np.ndarray) -> np.ndarray:
        low, high = (d.shape[1] - 1) // 2, d.shape[1] // 2
        d = np.partition(d, (low, high, d.shape[1] - 1), axis=1)  # NaN stands last
        return d[:, low] * 0.5 + d[:, high] * 0.5 if low < high else d[:, low]

    schema = T.StructType([rows.schema["key_a"], rows.schema[group], T.StructField("distance", T.DoubleType())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        keys = a["key_a"].combine_chunks().dictionary_encode("encode")
        codes = keys.indices.to_numpy()
        best, of = [None] * len(keys.dictionary), matrices(b["_w"])
        several: dict[int, list[np.ndarray]] = {}
        repeated = np.bincount(codes) > 1
        for size, (places, m) in matrices(a["_v"]).items():
            if size not in of or not len(of[size][0]):
                continue
            other = of[size][1].T
            step = max(1, cells // other.shape[1])
            single = np.flatnonzero(~repeated[codes[places]])
            for at in range(0, len(single), step):
                some = single[at : at + step]
                for code, value in zip(codes[places[some]].tolist(), middle(1 - m[some] @ other).tolist(), strict=True):
                    best[code] = value
            for i in np.flatnonzero(repeated[codes[places]]):
                several.setdefault(int(codes[places[i]]), []).append(1 - m[i] @ other)
        for code, parts in several.items():
            best[code] = float(middle(np.concatenate(parts)[None, :])[0])
        return pa.table({"key_a": keys.dictionary, group: pa.array([a[group][0].as_py()] * len(best), a.schema.field(group).type), "distance": pa.array(best, pa.float64())})

    return left.groupBy("_b", group).cogroup(right.groupBy("_c", "_h")).applyInArrow(compare, schema)


def closest_centroids(df: DataFrame, vector: str, group: str, metric: str = "cosine", max_groups: int = 10_000) -> DataFrame:
    """df with closest (the group whose median vector is nearest; ties: the smallest group) and distance. The medians are broadcast: one row per group."""
    centroids = vector_medians(df, vector, [group]).select(F.col(group).alias("_g"), "centroid")
    if centroids.limit(max_groups + 1).count() > max_groups:
        raise ValueError("too many groups to compare every row with all of them")
    gathered = centroids.agg(F.array_sort(F.collect_list(F.struct("_g", "centroid"))).alias("_all"))
    scored = F.transform("_all", lambda c: F.struct(METRICS[metric](F.col(vector), c["centroid"]).alias("distance"), c["_g"].alias("g")))
    best = df.crossJoin(F.broadcast(gathered)).withColumn("_best", F.array_min(F.filter(scored, lambda s: s["distance"].isNotNull())))
    return best.withColumns({"closest": F.col("_best.g"), "distance": F.col("_best.distance")}).drop("_all", "_best")


def confusion(df: DataFrame, expected: str, found: str) -> DataFrame:
    """expected, found, n with zero rows for all pairs of groups present."""
    counts = df.groupBy(expected, found).agg(F.count("*").alias("n"))
    grid = df.select(expected).distinct().crossJoin(df.select(found).distinct())
    return grid.join(counts, [expected, found], "left").select(expected, found, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _unit_sums(df: DataFrame, keys: Sequence[str], vector: str, name: str) -> DataFrame:
    """keys, the sum of the rows' unit vectors under the name, and their number: of rows whose vector has a length; others have no distance. Coordinates are rows: no group is gathered."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    units = df.select(*keys, F.transform(vector, lambda v: v.cast("double")).alias("_v"), norm.alias("_norm")).where("_norm > 0")
    parts = units.select(*keys, F.posexplode(F.transform("_v", lambda v: v / F.col("_norm"))).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"), F.count("*").alias("_n"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"])
    return sums.groupBy(*keys).agg(packed.alias(name), F.max("_n").alias(f"{name}_n"))


def silhouettes(df: DataFrame, key: str, vector: str, group: str, metric: str = "cosine", max_groups: int = 10_000) -> DataFrame:
    """key, group, silhouette: (nearest other group's mean distance - own group's) / the larger one; 0 for a group of one.

    A mean of cosine distances to a group is 1 - the product with the mean of its unit vectors, so rows meet groups, not each other; the rows of the key itself
    are taken out of the sums. Other metrics compare all pairs of rows.
    """
    df = df.where(F.col(key).isNotNull())
    own = df.select(F.col(key).alias("key_a"), F.col(group)).distinct()
    width = F.when(F.size(vector) > 0, F.size(vector))
    seen = df.agg(F.min(width).alias("least"), F.max(width).alias("most"), F.min(key).alias("first"), F.max(key).alias("last")).first()
    if seen["first"] == seen["last"]:  # no row has another one to be compared with
        own = own.limit(0)
    if metric == "cosine" and seen["least"] == seen["most"]:
        named = df.select(F.col(key).alias("key_a"), F.col(group), vector)
        rows = materialize(_unit_sums(named, ["key_a", group], vector, "_a"), "unit-sums")
        sums = _unit_sums(df.select(F.col(group).alias("_gb"), vector), ["_gb"], vector, "_s")
        if sums.limit(max_groups + 1).count() <= max_groups:
            sums = F.broadcast(sums)
        # what a key has in a group, if it has rows in several
        held = rows.select("key_a", F.struct(F.col(group).alias("g"), F.col("_a").alias("v"), F.col("_a_n").alias("n")).alias("h")).groupBy("key_a").agg(F.collect_list("h").alias("_held"))
        pairs = rows.join(held, "key_a").crossJoin(sums)
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        mine = F.filter("_held", lambda h: h["g"].eqNullSafe(F.col("_gb")))
        own_dot = F.aggregate(mine, F.lit(0.0), lambda s, h: s + dot(F.col("_a"), h["v"]))
        own_n = F.aggregate(mine, F.lit(0).cast("long"), lambda s, h: s + h["n"])
        others = F.col("_s_n") - own_n
        mean = 1 - (dot(F.col("_a"), F.col("_s")) - own_dot) / (F.col("_a_n") * others)
        joined = pairs.where(others > 0).select("key_a", group, "_gb", mean.alias("_d"))
        a = F.max(F.when(F.col("_gb") == F.col(group), F.col("_d")))
        b = F.min(F.when(F.col("_gb") != F.col(group), F.col("_d")))
        scored = joined.groupBy("key_a", group).agg(a.alias("a"), b.alias("b"))
        out = own.alias("o").join(scored.alias("s"), F.col("o.key_a").eqNullSafe(F.col("s.key_a")) & F.col(f"o.{group}").eqNullSafe(F.col(f"s.{group}")), "left").select("o.key_a", f"o.{group}", "a", "b")
    else:
        named = df.select(F.col(key).alias("key_b"), F.col(group).alias("_gb"))
        distances = pairwise_distances(df, df, key, vector, metric).where("key_a <> key_b").join(named, "key_b")
        means = distances.groupBy("key_a", "_gb").agg(F.avg("distance").alias("_d"))
        joined = means.join(own, "key_a")
        a = F.max(F.when(F.col("_gb") == F.col(group), F.col("_d")))
        b = F.min(F.when(F.col("_gb") != F.col(group), F.col("_d")))
        out = joined.groupBy("key_a", group).agg(a.alias("a"), b.alias("b"))
    return out.select(F.col("key_a").alias(key), group, F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))


def assign(costs: DataFrame, problem: Sequence[str], row: str, column: str, cost: str, maximize: bool = False) -> DataFrame:
    """problem keys, row, column, cost of the assignment with the least (or largest) total, one independent problem per key.

    Problems are groups of their own; within one, rows and columns are matched by shortest augmenting paths on its matrix. Absent cells cannot be
    used; a problem with fewer columns than rows leaves rows out.
    """
    import numpy as np
    import pandas as pd

    def match(c: np.ndarray) -> list[tuple[int, int]]:
        flip = c.shape[0] > c.shape[1]
        c = c.T if flip else c
        n, m = c.shape
        u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
        for i in range(1, n + 1):
            owner[0], at = i, 0
            least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
            while owner[at]:
                done[at] = True
                reduced = c[owner[at] - 1] - u[owner[at]] - v[1:]
                better = ~done[1:] & (reduced < least[1:])
                least[1:][better], came[1:][better] = reduced[better], at
                open_ = np.where(done, np.inf, least)
                open_[0] = np.inf
                to = int(open_.argmin())
                step = open_[to]
                u[owner[done]] += step
                v[done] -= step
                least[~done] -= step
                at = to
            while at:
                owner[at] = owner[came[at]]
                at = came[at]
        pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
        return [(j, i) for i, j in pairs] if flip else pairs

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="_r", columns="_c", values="_w", aggfunc="first")
        sign = -1.0 if maximize else 1.0
        c = sign * wide.to_numpy(float)
        missing = np.isnan(c)
        big = 1.0 + 2 * np.nansum(np.abs(c))
        pairs = [(i, j) for i, j in match(np.where(missing, big, c)) if not missing[i, j]]
        return pd.DataFrame([(*pdf[list(problem)].iloc[0], wide.index[i], wide.columns[j], sign * c[i, j]) for i, j in pairs], columns=[*problem, row, column, cost])

    rows = costs.select(*problem, F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(cost).cast("double").alias("_w"))
    types = dict(costs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*problem, row, column)) + f", `{cost}` double"
    return rows.groupBy(*problem).applyInPandas(solve, schema)


def column_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, value: the Pearson correlation of each pair of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cells = F.array(*(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs for x, y in ((a, b), (b, a))))
    return row.select(F.inline(cells))


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """key_a, key_b, distance, rank of the k nearest rows of each row, by comparing all."""
    d = pairwise_distances(df, df, key, vector, metric).where("key_a <> key_b")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("key_a").orderBy("distance", "key_b"))).where(F.col("rank") <= k)
