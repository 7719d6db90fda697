"""Filters, set operations, splits and samples. Samples rank rows by a hash of their key, so reruns and other partitionings agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME
from ethoframe.graph import components
from ethoframe.operators.align import neighbourhoods
from ethoframe.operators.quantiles import quantiles
from ethoframe.operators.runs import onset_counters, run_length_encode
from ethoframe.shared import materialize


def filter_equal(df: DataFrame, criteria: Mapping) -> DataFrame:
    """Rows whose columns, as text, equal the given values."""
    on = [F.col(c).cast("string") == F.lit(str(v)) for c, v in criteria.items()]
    return df.where(reduce(lambda a, b: a & b, on, F.lit(True)))


def filter_any(df: DataFrame, criteria: Sequence[Mapping]) -> DataFrame:
    """Bag union of the filters: a row comes once for every filter that it passes."""
    test = lambda m: reduce(lambda a, b: a & b, (F.col(c).cast("string") == F.lit(str(v)) for c, v in m.items()), F.lit(True))
    times = F.filter(F.array(*(F.when(test(m), F.lit(i)) for i, m in enumerate(criteria))), lambda x: x.isNotNull())
    return df.withColumn("_times", F.explode(times)).drop("_times")


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.regexp_like(F.col(column), F.lit(pattern)))


def group_counts(df: DataFrame, columns: Sequence[str], name: str = "duplications") -> DataFrame:
    """Rows per key; keys with a null are left out."""
    kept = reduce(lambda d, c: d.where(F.col(c).isNotNull()), columns, df)
    return kept.groupBy(*columns).agg(F.count("*").alias(name))


def categorical_histogram(df: DataFrame, column: str, alphabetical: bool = False) -> DataFrame:
    """Value, n, density and cumulative density, the largest (or alphabetically first) value first. The windows run over the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    order = [F.col(column)] if alphabetical else [F.desc("n"), F.col(column)]
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(column, "n", (F.col("n") / total).alias("density"), (running / total).alias("cumulative"))


def quantile_pairs(a: DataFrame, b: DataFrame, column: str, n: int = 100) -> DataFrame:
    """n evenly spaced quantiles of two samples, side by side."""
    at = [i / (n - 1) for i in range(n)]
    one = lambda d, name: quantiles(d, [], [column], at).select(F.col(column).alias(name))
    both = one(a, "sample_a").crossJoin(one(b, "sample_b"))
    zipped = F.arrays_zip("sample_a", "sample_b")
    return both.select(F.posexplode(zipped).alias("i", "z")).select((F.col("i") / (n - 1)).alias("q"), F.col("z.sample_a").alias("sample_a"), F.col("z.sample_b").alias("sample_b"))


def stats_in_limits(df: DataFrame, value: str, limits: DataFrame, position: str) -> DataFrame:
    """start, stop and the sum of the values at positions in [start, stop); a position is an equi-join key after expansion."""
    wanted = limits.where("stop > start").select("start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias(position))
    sums = wanted.join(df.select(position, value), position, "left").groupBy("start", "stop").agg(F.sum(value).alias("total"))
    return limits.select("start", "stop").distinct().join(sums, ["start", "stop"], "left")


def overlap_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of boolean columns."""
    return df.groupBy(*(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in columns)).agg(F.count("*").alias("n"))


def hash_rank(keys: Sequence[str], seed: int, by: Sequence[str] = ()) -> Column:
    """Rank from 1 by a seeded hash of the keys, per group. Without groups one task ranks the keys."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *keys), *keys))


def _with_rank(df: DataFrame, keys: Sequence[str], seed: int, by: Sequence[str]) -> DataFrame:
    """_place: the rank from 0 of each row by a seeded hash, within its group of ``by``.

    Ranks are taken in 4,096 hash ranges per group and offset by the ranges before, so that no task sorts a whole group.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).withColumn("_range", F.shiftright("_h", 52))
    sizes = hashed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_range").alias("_r"), before.alias("_before"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by), F.col("_range") == F.col("_r"))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", *keys)))
    return ranked.join(offsets, on).withColumn("_place", F.col("_before") + F.col("_rank") - 1).select(*df.columns, "_place")


def split_parts(df: DataFrame, keys: Sequence[str], parts: int, seed: int = 0, by: Sequence[str] = (), name: str = "part") -> DataFrame:
    """Rows dealt to parts whose sizes differ by one at most within each group of ``by``."""
    return _with_rank(df, keys, seed, by).withColumn(name, F.pmod("_place", F.lit(parts)).cast("int")).drop("_place")


def split_sharing(df: DataFrame, keys: Sequence[str], samples: int, share: float = 0.0, share_count: int = 2, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Samples of the rows: a share of them goes to share_count samples each, in equal parts per combination, the rest to one."""
    dealt = _with_rank(df, keys, seed, by)
    combos = list(combinations(range(samples), share_count)) if share > 0 else []
    so_far = F.floor(F.col("_place") * share)  # shared rows before this one
    shared = F.floor((F.col("_place") + 1) * share) > so_far
    one = F.array(F.pmod(F.col("_place") - so_far, F.lit(samples)).cast("int"))
    many = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in combos)), F.pmod(so_far, F.lit(len(combos))).cast("int") + 1) if combos else one
    return dealt.withColumn("sample", F.explode(F.when(shared, many).otherwise(one))).drop("_place")


def split_overlaps(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sample_a, sample_b and the keys that both have."""
    rows = samples.select(*keys, "sample").distinct()
    sets = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("sample")).alias("_s"))
    pairs = sets.select(F.explode("_s").alias("sample_a"), "_s").select("sample_a", F.explode("_s").alias("sample_b"))
    return pairs.where("sample_a <= sample_b").groupBy("sample_a", "sample_b").agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, by: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows of each group."""
    return df.withColumn("_rank", hash_rank(keys, seed, by)).where(F.col("_rank") <= n).drop("_rank")


def sampled_trajectories(moseq: DataFrame, track: DataFrame, label: str, ids: Sequence[str], n: int, before: int = 0, after: int | None = None, seed: int = 42) -> DataFrame:
    """Up to n runs of each label, each with its frames (or a window from its start), joined with the track.

    Runs are those of the frames that both tables have; a window must lie within the id's frames. Columns: label, ids, occurrence_id, label_frame, frame_index and the track's.
    """
    shared = moseq.join(track.select(*ids, FRAME).distinct(), [*ids, FRAME], "left_semi")
    counted = onset_counters(moseq, label, ids).select(*ids, FRAME, "occurrence_id")
    runs = run_length_encode(shared, label, ids).where("run_value IS NOT NULL")
    limits = shared.groupBy(*ids).agg(F.max(FRAME).alias("_hi"), F.min(FRAME).alias("_lo"))
    end = F.col("end_index") if after is None else F.col("start_index") + after
    runs = runs.join(limits, list(ids)).withColumn("_end", end).where((F.col("start_index") - before >= F.col("_lo")) & (F.col("_end") <= F.col("_hi")))
    picked = sample_rows(runs, [*ids, "start_index"], n, ["run_value"], seed)
    starts = picked.select(*ids, F.col("start_index").alias(FRAME), F.col("_end").alias("_last"), F.col("run_value").alias(label))
    values = [c for c in track.columns if c not in (*ids, FRAME)]
    near = neighbourhoods(track, starts, ids, values, before, end="_last")
    named = near.withColumnsRenamed({"offset": "label_frame"}).withColumn(FRAME, F.col("reference_frame_index") + F.col("label_frame"))
    starts = starts.select(*ids, F.col(FRAME).alias("reference_frame_index"), label).join(counted.withColumnRenamed(FRAME, "reference_frame_index"), [*ids, "reference_frame_index"])
    return named.join(starts, [*ids, "reference_frame_index"]).select(label, *ids, "occurrence_id", "label_frame", FRAME, *values)


def joined_sets(members: DataFrame, set_id: str, member: str) -> DataFrame:
    """member, group: sets that share members become one group, named by their smallest set_id (components of the links from each set to the smallest one of each member)."""
    spread = materialize(members.select(set_id, member).distinct(), "sets-members")
    named = spread.where(F.col(member).isNotNull() & F.col(set_id).isNotNull())
    first = named.groupBy(member).agg(F.min(set_id).alias("b"))
    roots = components(named.join(first, member).where(F.col(set_id) != F.col("b")).select(F.col(set_id).alias("a"), "b"))
    # a set that shares no member has no link and stays its own group
    rooted = lambda df: df.join(roots.withColumnRenamed("id", set_id), set_id, "left").select(member, F.coalesce("component", F.col(set_id)).alias("group"))
    groups = rooted(named)
    unnamed = spread.where(F.col(member).isNull() & F.col(set_id).isNotNull())
    if unnamed.limit(1).count():  # a null member joins no sets
        groups = groups.unionByName(rooted(unnamed.join(named.select(set_id).distinct(), set_id, "left_semi")))
    return groups.distinct()


def are_disjoint(members: DataFrame, set_id: str, member: str) -> DataFrame:
    """One row: whether no member is in two sets."""
    return members.select(set_id, member).distinct().groupBy(member).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("disjoint"))
