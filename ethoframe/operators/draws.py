"""Weighted draws that reruns and other partitionings repeat: every draw is a hash of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(keys: Sequence[str | Column], seed: int = 0) -> Column:
    """A number from [0, 1) by key: 48 bits of a digest of seed and keys, joined by colons; nulls count as empty."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def choose(values: Column, weights: Column, u: Column) -> Column:
    """One element of an array per row: the first whose running weight exceeds u * total. Null and negative weights count as 0; without weight the result is null."""
    clean = F.transform(weights, lambda w: F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0)))
    start = F.struct(F.lit(0.0).alias("sum"), F.expr("CAST(array() AS array<double>)").alias("sums"))
    sums = F.aggregate(clean, start, lambda a, w: F.struct((a["sum"] + w).alias("sum"), F.array_append(a["sums"], a["sum"] + w).alias("sums")), lambda a: a["sums"])
    place = F.transform(F.array(sums), lambda s: F.array_size(F.filter(s, lambda x: x <= u * F.element_at(s, -1))))[0]
    return F.when(F.size(clean) > 0, F.get(values, place))


def choose_uniform(values: Column, u: Column) -> Column:
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def running_weights(df: DataFrame, keys: Sequence[str], weight: str, ranges: int = 4096) -> DataFrame:
    """df with _low and _high: the share of [0, 1) that each row takes by its weight, rows in an order by hash.

    Weights are summed in hash ranges and offset by the ranges before, so no task sees all rows. Rows without positive weight are left out.
    """
    positive = df.where(F.col(weight) > 0).withColumn("_h", F.xxhash64(F.lit("range"), *keys)).withColumn("_range", F.pmod("_h", F.lit(ranges)))
    # weights as whole units: sums don't depend on the order of rows
    scaled = positive.withColumn("_w", F.round(F.col(weight).cast("double") * 1e6).cast("decimal(38,0)"))
    sizes = scaled.groupBy("_range").agg(F.sum("_w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inside = F.sum("_w").over(Window.partitionBy("_range").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, 0))
    placed = scaled.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
    high, total = (F.col("_before") + F.col("_inside")).cast("double"), F.col("_total").cast("double")
    low = (F.col("_before") + F.col("_inside") - F.col("_w")).cast("double")
    return placed.select(*df.columns, (low / total).alias("_low"), (high / total).alias("_high"))


def draw_rows(df: DataFrame, keys: Sequence[str], weight: str, draws: DataFrame, draw_keys: Sequence[str], seed: int = 0) -> DataFrame:
    """draws with the columns of the row that each draws, with replacement, by weight.

    [0, 1) is cut into cells of equal size, about as many as rows; a row is listed in the cells that its share touches, and a draw looks into one cell: an equi join.
    A row of great weight touches many cells, each of them once.
    """
    shares = running_weights(df, keys, weight)
    cells = max(1, shares.count())
    listed = shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.floor(F.col("_high") * cells), F.lit(cells - 1)))))
    asked = draws.withColumn("_u", uniform(draw_keys, seed)).withColumn("_cell", F.least(F.floor(F.col("_u") * cells), F.lit(cells - 1)))
    return asked.join(listed, "_cell").where("_u >= _low AND _u < _high").drop("_cell", "_low", "_high", "_u")


def sample_without_replacement(df: DataFrame, keys: Sequence[str], weight: str, n: int, by: Sequence[str] = (), seed: int = 0, salts: int = 64) -> DataFrame:
    """n rows (of each group) drawn one after the other by weight: those with the least -ln(u) / weight.

    Groups are ranked in salted parts first and their best n again, so that a group of any size takes no single task. Without groups it is one distributed top n.
    """
    u = uniform(keys, seed)
    scored = df.where(F.col(weight) > 0).withColumn("_e", -F.ln(F.when(u > 0, u).otherwise(F.lit(2.0**-49))) / F.col(weight))
    if not by:
        return scored.orderBy("_e", *keys).limit(n).drop("_e")
    rank = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy("_e", *keys))
    best = scored.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), *keys), F.lit(salts))).withColumn("_r", rank(*by, "_salt")).where(F.col("_r") <= n)
    return best.withColumn("_r", rank(*by)).where(F.col("_r") <= n).drop("_e", "_salt", "_r")
