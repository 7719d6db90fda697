"""Run-length encoding, segments and interval expansion: windows over (ids, order), then one aggregate on the same keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ethoframe.frames import FRAME, ordered

#: A series without ids is cut at multiples of so many steps of its order column.
FLAT_BLOCK = 1_000_000


def run_starts(value: str, ids: Sequence[str], order: str = FRAME, break_on_gap: bool = False) -> Column:
    """True where a row differs from the row before it (null equals null); the first row of an id always starts a run."""
    w = ordered(ids, order)
    change = F.row_number().over(w) == 1
    change = change | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return change | (F.col(order) - F.lag(order).over(w) > 1) if break_on_gap else change


def _numbered_runs(df: DataFrame, value: str, ids: Sequence[str], order: str, break_on_gap: bool) -> DataFrame:
    """ids, _run (from 1 within an id), start_index, end_index, run_value."""
    marked = df.select(*ids, F.col(order).alias("_at"), F.col(value).alias("_value"), run_starts(value, ids, order, break_on_gap).cast("long").alias("_new"))
    numbered = marked.withColumn("_run", F.sum("_new").over(ordered(ids, "_at").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*ids, "_run").agg(F.min("_at").alias("start_index"), F.max("_at").alias("end_index"), F.first("_value").alias("run_value"))


def _flat_runs(df: DataFrame, value: str, order: str, break_on_gap: bool) -> DataFrame:
    """Runs of one series, encoded block by block of the order column; only each block's first and last run can go on in another block.

    One task sees these runs alone, at most two for every FLAT_BLOCK steps of the order column, and joins those that continue each other.
    """
    block = F.floor(F.col(order) / FLAT_BLOCK)
    runs = _numbered_runs(df.select(F.col(order), F.col(value), block.alias("_block")), value, ["_block"], order, break_on_gap)
    runs = runs.withColumn("_last", F.max("_run").over(Window.partitionBy("_block")))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_block", "_run")
    before = lambda c: F.lag(c).over(whole)
    fresh = (F.row_number().over(whole) == 1) | F.col("_block").eqNullSafe(before("_block")) | ~F.col("run_value").eqNullSafe(before("run_value"))
    fresh = fresh | (F.col("start_index") - before("end_index") > 1) if break_on_gap else fresh
    edges = runs.where(edge).withColumn("_new", fresh.cast("long"))
    edges = edges.withColumn("_joined", F.sum("_new").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("_joined").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.first("run_value").alias("run_value"))
    columns = ["start_index", "end_index", "run_value"]
    return runs.where(~edge).select(*columns).unionByName(joined.select(*columns))


def run_length_encode(df: DataFrame, value: str, ids: Sequence[str] = (), order: str = FRAME, drop_values: Sequence = (), break_on_gap: bool = False) -> DataFrame:
    """ids, start_index, end_index, run_length, run_value.

    Neighbouring rows make a run, so a gap in the order column does not end one and counts in its length (unless break_on_gap). Rows that share an order value
    belong to the run in which they sort. A series without ids whose order column holds whole numbers is encoded by blocks (_flat_runs).
    """
    if not ids and isinstance(df.schema[order].dataType, T.IntegralType):
        runs = _flat_runs(df, value, order, break_on_gap)
    else:
        runs = _numbered_runs(df, value, ids, order, break_on_gap)
    out = runs.select(*ids, "start_index", "end_index", (F.col("end_index") - F.col("start_index") + 1).alias("run_length"), "run_value")
    for v in drop_values:
        out = out.where(F.col("run_value").isNotNull()) if v is None else out.where(~F.col("run_value").eqNullSafe(F.lit(v)))
    return out


def expand_limits(df: DataFrame, start: str, end: str, name: str = "index", inclusive: bool = True, keep_limits: bool = False) -> DataFrame:
    """Each row once for every integer of its interval; an interval that ends before it starts gives no row."""
    last = F.col(end) if inclusive else F.col(end) - 1
    kept = df.where(last >= F.col(start))
    out = kept.withColumn(name, F.explode(F.sequence(F.col(start), last)))
    return out if keep_limits else out.drop(*{start, end} - {name})


def expand_runs(runs: DataFrame, name: str = "index", value_name: str = "run_value") -> DataFrame:
    """The inverse of run_length_encode(): one row for every index of every run."""
    return expand_limits(runs, "start_index", "end_index", name).drop("run_length").withColumnRenamed("run_value", value_name)


def value_chunks(df: DataFrame, value: str, ids: Sequence[str] = (), order: str = FRAME, skip_values: Sequence = ()) -> DataFrame:
    """Runs under the names index_start, index_end, value, length, with the ids as one struct, too."""
    runs = run_length_encode(df, value, ids, order, skip_values)
    grouped = F.struct(*ids).alias("grouped_index") if ids else F.struct(F.lit(0).alias("all")).alias("grouped_index")
    return runs.select(*ids, F.col("start_index").alias("index_start"), F.col("end_index").alias("index_end"), F.col("run_value").alias("value"), F.col("run_length").alias("length"), grouped)


def chunks_to_series(chunks: DataFrame, name: str = "index") -> DataFrame:
    """The inverse of value_chunks()."""
    return expand_limits(chunks, "index_start", "index_end", name).drop("length", "grouped_index")


def segment_ids(df: DataFrame, flag: str, ids: Sequence[str], order: str = FRAME, starts: bool = True, name: str = "segment") -> DataFrame:
    """Number the segments that a true flag starts, or ends (then the next row starts one)."""
    w = ordered(ids, order).rowsBetween(Window.unboundedPreceding, 0 if starts else -1)
    return df.withColumn(name, F.coalesce(F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).over(w), F.lit(0)))


def consecutive_true(df: DataFrame, flag: str, ids: Sequence[str], order: str = FRAME, name: str = "consecutive") -> DataFrame:
    """Number of true rows in a row up to this one; a false or null row has 0."""
    w = ordered(ids, order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    total = df.withColumn("_sum", F.sum(on.cast("long")).over(w))
    reset = F.last(F.when(~on, F.col("_sum")), ignorenulls=True).over(w)
    return total.withColumn(name, F.col("_sum") - F.coalesce(reset, F.lit(0))).drop("_sum")


def rising_pairs(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """Rows at which the column rises, and the rows directly before them."""
    w = ordered(ids, order)
    up = F.coalesce(F.col(column) - F.lag(column).over(w) > 0, F.lit(False))
    next_up = F.coalesce(F.lead(column).over(w) - F.col(column) > 0, F.lit(False))
    return df.withColumn("_near", up | next_up).where("_near").drop("_near")


def merge_chunks(chunks: DataFrame, ids: Sequence[str] = (), tolerance: float = 0.0) -> DataFrame:
    """Merge a chunk into the one before it while its value is within tolerance of the mean of all chunks merged there.

    A fold over the chunks of an id in order (start_index, end_index, run_value); its state is one array per id.
    """
    item = F.struct(F.col("start_index").alias("s"), F.col("end_index").alias("e"), F.col("run_value").cast("double").alias("v"))
    gathered = chunks.groupBy(*ids).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    empty = F.expr("cast(array() as array<struct<s: bigint, e: bigint, total: double, n: bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"), x["v"].alias("total"), F.lit(1).cast("long").alias("n"))
        grown = F.struct(last["s"].alias("s"), x["e"].cast("long").alias("e"), (last["total"] + x["v"]).alias("total"), (last["n"] + 1).alias("n"))
        near = F.when(F.size(acc) > 0, F.abs(x["v"] - last["total"] / last["n"]) <= tolerance).otherwise(False)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    merged = gathered.select(*ids, F.explode(F.aggregate("_items", empty, step)).alias("m"))
    return merged.select(*ids, F.col("m.s").alias("start_index"), F.col("m.e").alias("end_index"), (F.col("m.total") / F.col("m.n")).alias("run_value"), F.col("m.n").alias("n_chunks"))


def full_frames(df: DataFrame, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """Every integer from the first to the last order value of each id."""
    span = df.groupBy(*ids).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")).where("_hi >= _lo")
    return span.select(*ids, F.explode(F.sequence("_lo", "_hi")).alias(order))


def onset_counters(df: DataFrame, label: str, ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """onset (a run starts), label_frame (frames since the onset) and occurrence_id (the number of earlier onsets of the label over all ids).

    occurrence_id counts over ids in their order. The runs, not the frames, are ranked for it, in two steps: within each (label, id), then
    over the running totals of the ids, so no task gets all frames of a label.
    """
    w = ordered(ids, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("onset", run_starts(label, ids, order))
    marked = marked.withColumn("_start", F.last(F.when(F.col("onset"), F.col(order)), ignorenulls=True).over(w))
    marked = marked.withColumn("_row", F.row_number().over(ordered(ids, order))).withColumn("_first", F.last(F.when(F.col("onset"), F.col("_row")), ignorenulls=True).over(w))
    marked = marked.withColumn("label_frame", (F.col("_row") - F.col("_first")).cast("long"))
    within = F.sum(F.col("onset").cast("long")).over(ordered([label, *ids], order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_within", within)
    totals = marked.groupBy(label, *ids).agg(F.sum(F.col("onset").cast("long")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(ordered([label], list(ids)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col(label).alias("_label"), *(F.col(c).alias(f"_{c}") for c in ids), before.alias("_before"))
    on = F.col(label).eqNullSafe(F.col("_label"))
    for c in ids:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = marked.join(offsets, on).withColumn("occurrence_id", F.col("_before") + F.col("_within") - 1)
    return out.select(*df.columns, "onset", "label_frame", "occurrence_id")
