"""n-grams, transition frequencies, exact and fuzzy patterns over label sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME, ordered
from ethoframe.functions.arrays import hamming_matches
from ethoframe.operators.runs import expand_limits, run_length_encode, run_starts


def run_onsets(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """The first row of every run."""
    return df.withColumn("_new", run_starts(label, ids, order)).where("_new").drop("_new")


def ngram_counts(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME, n: int = 2, step: int = 1, below=None, per_id: bool = False, runs_only: bool = True) -> DataFrame:
    """Counts of n labels, each ``step`` rows after the last, as columns g0 ... ; n-grams with nulls, or labels not below the limit, are left out."""
    rows = run_onsets(df, label, ids, order) if runs_only else df
    w = ordered(ids, order)
    rows = rows.select(*ids, *((F.lead(label, k * step).over(w) if k else F.col(label)).alias(f"g{k}") for k in range(n)))
    for k in range(n):
        rows = rows.where(F.col(f"g{k}").isNotNull() if below is None else F.col(f"g{k}") < below)
    return rows.groupBy(*(ids if per_id else ()), *(f"g{k}" for k in range(n))).agg(F.count("*").alias("n"))


def normalise_ngrams(counts: DataFrame, by: str | None, order: int = 2, ids: Sequence[str] = (), smoothing: float = 0.0) -> DataFrame:
    """Shares of counts: by None (as they are), "bigram" (of all), "rows" (of the first label) or "columns" (of the last)."""
    n = F.col("n") + smoothing
    if by is None:
        return counts.withColumn("share", n.cast("double"))
    if by not in ("bigram", "rows", "columns"):
        raise ValueError("by is None, bigram, rows or columns")
    within = {"bigram": [], "rows": ["g0"], "columns": [f"g{order - 1}"]}[by]
    keys = [*ids, *within]
    if not keys:
        total = counts.agg(F.sum(n).alias("_total"))
        return counts.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(n, "_total")).drop("_total")
    return counts.withColumn("share", F.try_divide(n, F.sum(n).over(Window.partitionBy(*keys))))


def full_pairs(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Bigram counts with zero rows for all pairs of labels (one column, few rows)."""
    name = labels.columns[0]
    grid = labels.select(F.col(name).alias("g0")).crossJoin(labels.select(F.col(name).alias("g1")))
    return grid.join(counts, ["g0", "g1"], "left").select("g0", "g1", F.coalesce("n", F.lit(0)).alias("n"))


def stronger_direction(cells: DataFrame, value: str = "n") -> DataFrame:
    """Cells (g0, g1, value) kept where they exceed the opposite one, else 0."""
    back = cells.select(F.col("g1").alias("g0"), F.col("g0").alias("g1"), F.col(value).alias("_back"))
    out = cells.join(back, ["g0", "g1"], "left")
    return out.select("g0", "g1", F.when(F.col(value) > F.coalesce("_back", F.lit(0)), F.col(value)).otherwise(F.lit(0)).alias(value))


def transition_matrix(cells: DataFrame, labels: Sequence, value: str = "n") -> DataFrame:
    """Rows g0, one column per label, 0 where no cell is."""
    return cells.groupBy("g0").pivot("g1", list(labels)).agg(F.first(value)).na.fill(0)


def label_frequencies(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME, by: Sequence[str] = (), runs_only: bool = True) -> DataFrame:
    """Share of each label among the runs (or frames), per group of ``by`` or over all."""
    rows = run_onsets(df, label, ids, order) if runs_only else df
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    if by:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def run_durations(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    runs = run_length_encode(df, label, ids, order)
    return runs.select(*ids, F.col("run_value").alias(label), F.col("run_length").alias("duration"))


def label_statistics(df: DataFrame, label: str, values: Sequence[str], ids: Sequence[str], order: str = FRAME, by: Sequence[str] = (), least_share: float = 0.005, fps: float = 30.0) -> DataFrame:
    """Per group and label: n, mean, std, min, quartiles and max of the values and of the run durations (seconds), and the share of runs.

    Labels whose share of all runs is not above least_share are left out.
    """
    common = label_frequencies(df, label, ids, order).where(F.col("share") > least_share).select(label)
    frames = df.join(F.broadcast(common), label)
    describe = lambda c, name: [F.count(c).alias(f"{name}_count"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), *(F.percentile(c, F.lit(q / 100)).alias(f"{name}_p{q}") for q in (25, 50, 75)), F.max(c).alias(f"{name}_max")]
    keys = [*by, label]
    stats = frames.groupBy(*keys).agg(*(a for v in values for a in describe(F.col(v).cast("double"), v)))
    runs = run_durations(df, label, ids, order).join(F.broadcast(common), label)
    spans = runs.groupBy(*keys).agg(*describe(F.col("duration") / fps, "duration")) if set(by) <= set(ids) else None
    shares = label_frequencies(df, label, ids, order, by).select(*keys, "share")
    return (stats.join(spans, keys) if spans is not None else stats).join(shares, keys)


def lag_occurrences(df: DataFrame, a: str, b: str, ids: Sequence[str], order: str = FRAME, most: int = 5) -> DataFrame:
    """lag, a, b and the share of frames with label a at t and label b at t - lag, for lags 0 to most."""
    w = ordered(ids, order)
    past = F.array(*(F.struct(F.lit(k).alias("lag"), (F.lag(b, k).over(w) if k else F.col(b)).alias("b")) for k in range(most + 1)))
    rows = df.select(F.col(a).alias("a"), past.alias("past")).select("a", F.inline("past"))
    counts = rows.select("lag", "a", "b").groupBy("lag", "a", "b").agg(F.count("*").alias("n")).where("a IS NOT NULL AND b IS NOT NULL")
    return counts.select("lag", "a", "b", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("lag"))).alias("share"))


def independent_joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and the product of their shares; the labels, not the frames, are multiplied."""
    share = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.count("*").alias(f"n_{name}"))
    left, right = share(a, "a"), share(b, "b")
    total = lambda d, name: d.agg(F.sum(f"n_{name}").alias(f"t_{name}"))
    grid = left.crossJoin(right).crossJoin(F.broadcast(total(left, "a"))).crossJoin(F.broadcast(total(right, "b")))
    return grid.select("a", "b", ((F.col("n_a") / F.col("t_a")) * (F.col("n_b") / F.col("t_b"))).alias("share"))


def sequence_occurrences(df: DataFrame, column: str, targets: Sequence[Sequence], ids: Sequence[str], order: str = FRAME, before: int = 0, name: str = "occurs") -> DataFrame:
    """Whether the values from ``before`` rows ahead on are one of the targets; rows whose window holds a null are left out for that target."""
    w = ordered(ids, order)

    def found(target: Sequence) -> Column:
        shifted = [F.lag(column, before - k).over(w) if k < before else F.col(column) if k == before else F.lead(column, k - before).over(w) for k in range(len(target))]
        whole = F.array(*shifted)
        return F.when(F.forall(whole, lambda x: x.isNotNull()), whole == F.array(*map(F.lit, target)))

    hits = F.array(*(found(t) for t in targets))
    known = F.exists(hits, lambda x: x.isNotNull())
    return df.withColumn(name, F.when(known, F.exists(F.filter(hits, lambda x: x.isNotNull()), lambda x: x))).where(F.col(name).isNotNull())


def pattern_frames(df: DataFrame, label: str, patterns: Sequence[Sequence], ids: Sequence[str], order: str = FRAME, name: str = "in_pattern") -> DataFrame:
    """ids, frame, label and whether the frame's run takes part in a place of a pattern of run values."""
    runs = run_length_encode(df, label, ids, order)
    w = ordered(ids, "start_index")
    flag = F.lit(False)
    for p in patterns:
        here = F.col("run_value").eqNullSafe(F.lit(p[0]))
        for k, v in enumerate(p[1:], 1):
            here = here & F.lead("run_value", k).over(w).eqNullSafe(F.lit(v))
        runs = runs.withColumn("_here", F.coalesce(here, F.lit(False)))
        runs = runs.withColumn("_part", F.max(F.col("_here").cast("int")).over(w.rowsBetween(-(len(p) - 1), 0)) == 1)
        runs = runs.withColumn("_any", F.coalesce(F.col("_any") if "_any" in runs.columns else flag, F.lit(False)) | F.col("_part"))
    return expand_limits(runs, "start_index", "end_index", order).select(*ids, order, F.col("run_value").alias(label), F.coalesce("_any", F.lit(False)).alias(name))


def run_sequences(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """ids and the run values, starts, ends and lengths of each id as arrays in order."""
    runs = run_length_encode(df, label, ids, order)
    rows = F.array_sort(F.collect_list(F.struct("start_index", "end_index", "run_length", "run_value")))
    part = lambda c: F.transform("_r", lambda x: x[c])
    return runs.groupBy(*ids).agg(rows.alias("_r")).select(*ids, part("run_value").alias("run_values"), part("start_index").alias("starts"), part("end_index").alias("ends"), part("run_length").alias("lengths"))


def window_patterns(sequences: DataFrame, length: int, skip_last: bool = False) -> DataFrame:
    """All distinct windows of a length of the run values; skip_last leaves out the last window of each sequence."""
    n = F.size("run_values") - length - (1 if skip_last else 0)
    kept = sequences.where(n >= 0)
    return kept.select(F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("run_values", i + 1, length))).alias("pattern")).distinct()


def pattern_matches(sequences: DataFrame, patterns: DataFrame, ids: Sequence[str], most: int = 0) -> DataFrame:
    """pattern, ids, match_idx, match, n_mismatches, mismatches, match_start and match_end (run positions), first and last frame, run_lengths.

    With exact patterns every window is a key of an equi join with the patterns; only fuzzy ones (most > 0) compare all patterns, which are
    then broadcast by the caller's choice of a small list.
    """
    if most == 0:
        sized = patterns.select(F.size("pattern").alias("k")).distinct().agg(F.sort_array(F.collect_set("k")).alias("_ks"))
        rows = sequences.crossJoin(F.broadcast(sized)).withColumn("_k", F.explode("_ks"))
        starts = F.sequence(F.lit(0), F.size("run_values") - F.col("_k"))
        windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("run_values", i + 1, F.col("_k")).alias("window")))
        rows = rows.where(F.size("run_values") >= F.col("_k")).select("*", F.explode(windows).alias("m"))
        found = rows.join(patterns, F.col("m.window") == F.col("pattern")).withColumn("wrong", F.expr("cast(array() as array<int>)"))
        found = found.select(*ids, "starts", "ends", "lengths", "pattern", F.col("m.start").alias("match_start"), F.col("m.window").alias("match"), "wrong")
    else:
        rows = sequences.crossJoin(F.broadcast(patterns)).select("*", F.explode(hamming_matches(F.col("run_values"), F.col("pattern"), most)).alias("m"))
        found = rows.select(*ids, "starts", "ends", "lengths", "pattern", F.col("m.start").alias("match_start"), F.col("m.window").alias("match"), F.col("m.wrong").alias("wrong"))
    at = F.row_number().over(Window.partitionBy("pattern", *ids).orderBy("match_start")) - 1
    size = F.size("pattern")
    return found.select(
        "pattern", *ids, at.alias("match_idx"), "match", F.size("wrong").alias("n_mismatches"), F.col("wrong").alias("mismatches"), "match_start", (F.col("match_start") + size).alias("match_end"),
        F.get("starts", F.col("match_start")).alias("sequence_index_start"), F.get("ends", F.col("match_start") + size - 1).alias("sequence_index_end"), F.slice("lengths", F.col("match_start") + 1, size).alias("run_lengths"),
    )


def match_occurrences(matches: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids and every frame that a match covers."""
    return expand_limits(matches.select(*ids, "sequence_index_start", "sequence_index_end"), "sequence_index_start", "sequence_index_end", FRAME).distinct()


def match_counts(matches: DataFrame, n_sequences: int) -> DataFrame:
    """pattern, its matches and matches per sequence."""
    return matches.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("per_sequence", F.try_divide("n", F.lit(n_sequences)))


def match_chunks(matches: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Matches as value chunks."""
    length = F.col("sequence_index_end") - F.col("sequence_index_start") + 1
    return matches.select(*ids, F.col("sequence_index_start").alias("index_start"), F.col("sequence_index_end").alias("index_end"), F.col("pattern").alias("value"), length.alias("length"), F.struct(*ids).alias("grouped_index"))
