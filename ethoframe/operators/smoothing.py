"""Rolling statistics, outlier filters, interpolation and kinematics over frames of an id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.frames import FRAME, ordered
from ethoframe.functions.angles import delta_angle
from ethoframe.operators.quantiles import medians

FPS = 30.00003
_STATS = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def smooth(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, size: int = 3, stat: str = "mean", center: bool = True, name: str | None = None) -> DataFrame:
    """A rolling statistic over full windows; null where the window is not full or holds a null."""
    span = (-(size // 2), (size - 1) // 2) if center else (-(size - 1), 0)
    w = ordered(ids, order).rowsBetween(*span)
    return df.withColumn(name or f"{column}_{stat}", F.when(F.count(column).over(w) == size, _STATS[stat](F.col(column)).over(w)))


def smooth_columns(df: DataFrame, params: dict[str, dict], ids: Sequence[str], order: str = FRAME) -> DataFrame:
    """smooth() with parameters of its own for each column."""
    for column, options in params.items():
        df = smooth(df, column, ids, order, **options)
    return df


def interpolate(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, limit: int | None = None, name: str | None = None) -> DataFrame:
    """Nulls between two values filled on the line between them, by row position; only in gaps of at most limit rows."""
    w = ordered(ids, order)
    at = F.row_number().over(w)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("i"), F.col(column).cast("double").alias("x")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("_at", at).withColumns({"_p": before, "_n": after})
    gap = F.col("_n.i") - F.col("_p.i") - 1
    line = F.col("_p.x") + F.try_divide((F.col("_n.x") - F.col("_p.x")) * (F.col("_at") - F.col("_p.i")), F.col("_n.i") - F.col("_p.i"))
    allowed = gap.isNotNull() if limit is None else gap <= limit
    return out.withColumn(name or column, F.coalesce(F.col(column).cast("double"), F.when(allowed, line))).drop("_at", "_p", "_n")


def modified_zscore(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "zscore") -> DataFrame:
    """0.6745 (x - median) / MAD over the rows of a group (or all); null where MAD is 0."""
    keys = list(by)
    center = medians(df, keys, [column]).withColumnRenamed(column, "_median")
    joined = df.join(center, keys) if keys else df.crossJoin(F.broadcast(center))
    spread = medians(joined.select(*keys, F.abs(F.col(column) - F.col("_median")).alias("_mad")), keys, ["_mad"])
    joined = joined.join(spread, keys) if keys else joined.crossJoin(F.broadcast(spread))
    return joined.withColumn(name, F.try_divide(0.6745 * (F.col(column) - F.col("_median")), F.col("_mad"))).drop("_median", "_mad")


def zscore_outliers(df: DataFrame, column: str, by: Sequence[str] = (), threshold: float = 3.5, name: str = "outlier") -> DataFrame:
    """True where the modified z-score reaches the threshold."""
    return modified_zscore(df, column, by, "_z").withColumn(name, F.coalesce(F.abs("_z") >= threshold, F.lit(False))).drop("_z")


def drop_zscore_outliers(df: DataFrame, column: str, by: Sequence[str] = (), threshold: float = 3.5) -> DataFrame:
    """Outliers replaced by null."""
    return zscore_outliers(df, column, by, threshold, "_out").withColumn(column, F.when(~F.col("_out"), F.col(column))).drop("_out")


def rolling_zscore(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, size: int = 30, name: str = "zscore") -> DataFrame:
    """The z-score against the median of the size rows before, and the median deviation of the last size rows."""
    w = ordered(ids, order)
    deviation = F.col(column) - F.percentile(column, F.lit(0.5)).over(w.rowsBetween(-size, -1))
    out = df.withColumn("_dev", deviation)
    spread = F.percentile(F.abs("_dev"), F.lit(0.5)).over(w.rowsBetween(-(size - 1), 0))
    return out.withColumn(name, F.try_divide(0.6745 * F.col("_dev"), spread)).drop("_dev")


def drop_rolling_outliers(df: DataFrame, columns: Sequence[str], ids: Sequence[str], order: str = FRAME, threshold: float = 3.5, size: int = 30) -> DataFrame:
    """Outliers replaced by null; a row with a null in any of the columns is null in all of them."""
    for c in columns:
        df = rolling_zscore(df, c, ids, order, size, f"_z_{c}")
    kept = {c: F.when(F.coalesce(F.abs(f"_z_{c}") < threshold, F.lit(True)), F.col(c)) for c in columns}
    whole = F.forall(F.array(*(kept[c].isNotNull() for c in columns)), lambda x: x)
    return df.withColumns({c: F.when(whole, F.col(c)) for c in columns} if len(columns) > 1 else kept).drop(*(f"_z_{c}" for c in columns))


def change_over_time(column: Column | str, ids: Sequence[str], order: str = FRAME, fps: float = FPS) -> Column:
    """Difference to the row before over the time between them; null in the first row."""
    w, c = ordered(ids, order), F.col(column) if isinstance(column, str) else column
    return F.try_divide(c - F.lag(c).over(w), (F.col(order) - F.lag(order).over(w)) / fps)


def angular_change(column: str, ids: Sequence[str], order: str = FRAME, radians: bool = True) -> Column:
    """The signed shortest turn since the row before."""
    return delta_angle(F.col(column), F.lag(column).over(ordered(ids, order)), radians)


def angular_speed(column: str, ids: Sequence[str], order: str = FRAME, radians: bool = True, fps: float = FPS) -> Column:
    w = ordered(ids, order)
    return F.try_divide(angular_change(column, ids, order, radians), (F.col(order) - F.lag(order).over(w)) / fps)


def acceleration(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, fps: float = FPS, name: str = "acceleration") -> DataFrame:
    """The change over time of the change over time."""
    return df.withColumn("_v", change_over_time(column, ids, order, fps)).withColumn(name, change_over_time("_v", ids, order, fps)).drop("_v")


def velocity_2d(df: DataFrame, x: str, y: str, ids: Sequence[str], order: str = FRAME, fps: float = FPS) -> DataFrame:
    """speed and direction (radians) of a point."""
    out = df.withColumns({"_vx": change_over_time(x, ids, order, fps), "_vy": change_over_time(y, ids, order, fps)})
    return out.withColumns({"speed": F.hypot("_vx", "_vy"), "direction": F.atan2("_vy", "_vx")}).drop("_vx", "_vy")


def acceleration_2d(df: DataFrame, x: str, y: str, ids: Sequence[str], order: str = FRAME, fps: float = FPS) -> DataFrame:
    """acceleration and acceleration_direction (radians) of a point."""
    out = acceleration(acceleration(df, x, ids, order, fps, "_ax"), y, ids, order, fps, "_ay")
    return out.withColumns({"acceleration": F.hypot("_ax", "_ay"), "acceleration_direction": F.atan2("_ay", "_ax")}).drop("_ax", "_ay")


def smooth_angle(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, size: int = 9, name: str = "angle") -> DataFrame:
    """Median of sine and cosine over a centred window, cut at the ends of the id; angle in radians."""
    w = ordered(ids, order).rowsBetween(-(size // 2), (size - 1) // 2)
    middle = lambda f: F.percentile(f(column), F.lit(0.5)).over(w)
    return df.withColumn(name, F.atan2(middle(F.sin), middle(F.cos)))


def value_sequences(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, before: int = 0, after: int = 0, keep_null: bool = True, name: str = "sequence") -> DataFrame:
    """The values of the rows around each row, as an array; rows with a null in it can be dropped."""
    w = ordered(ids, order)
    out = df.withColumn(name, F.array(*(F.lag(column, k).over(w) for k in range(before, 0, -1)), F.col(column), *(F.lead(column, k).over(w) for k in range(1, after + 1))))
    return out if keep_null else out.where(F.forall(name, lambda x: x.isNotNull()))


def true_frames(df: DataFrame, msec: str, fps: float, name: str = FRAME) -> DataFrame:
    """The frame number that a time stamp stands for, rounded half to even."""
    return df.withColumn(name, F.rint(F.col(msec) / (1000 / fps)).cast("long"))


def frame_skips(df: DataFrame, msec: str, ids: Sequence[str], order: str, fps: float, name: str = "skipped") -> DataFrame:
    """Frames missing between a row and the row before; 0 in the first row."""
    numbered = true_frames(df, msec, fps, "_frame")
    return numbered.withColumn(name, F.coalesce(F.col("_frame") - F.lag("_frame").over(ordered(ids, order)) - 1, F.lit(0))).drop("_frame")


def frame_presence(df: DataFrame, msec: str, ids: Sequence[str], fps: float) -> DataFrame:
    """ids, frame_index from 1 to the last frame, and whether the frame is there."""
    seen = true_frames(df, msec, fps).select(*ids, FRAME).distinct()
    grid = seen.groupBy(*ids).agg(F.max(FRAME).alias("_hi")).where("_hi >= 1").select(*ids, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_hi"))).alias(FRAME))
    return grid.join(seen.withColumn("present", F.lit(True)), [*ids, FRAME], "left").select(*ids, FRAME, F.coalesce("present", F.lit(False)).alias("present"))


def fix_timestamps(df: DataFrame, msec: str, ids: Sequence[str], order: str, remove: Sequence[float] = (0,), name: str = "msec") -> DataFrame:
    """Values to remove become gaps, and gaps are filled on the line between neighbours, or at the ends on the line through the two nearest."""
    clean = df.withColumn(name, F.when(~F.col(msec).isin(*remove), F.col(msec).cast("double")))
    w = ordered(ids, order)
    out = interpolate(clean, name, ids, order).withColumn("_i", F.row_number().over(w))
    whole = Window.partitionBy(*ids).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.when(F.col(name).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(name).alias("x")))
    out = out.withColumns({"_p": known})
    edge = {"_f": F.first("_p", ignorenulls=True).over(whole), "_l": F.last("_p", ignorenulls=True).over(whole)}
    out = out.withColumns(edge)
    second = F.when(F.col("_i") == F.col("_f.i") + 1, F.col(name)), F.when(F.col("_i") == F.col("_l.i") - 1, F.col(name))
    out = out.withColumns({"_f2": F.first(second[0], ignorenulls=True).over(whole), "_l2": F.last(second[1], ignorenulls=True).over(whole)})
    before = F.col("_f.x") + (F.col("_i") - F.col("_f.i")) * (F.col("_f2") - F.col("_f.x"))
    after = F.col("_l.x") + (F.col("_i") - F.col("_l.i")) * (F.col("_l.x") - F.col("_l2"))
    filled = F.coalesce(F.col(name), F.when(F.col("_i") < F.col("_f.i"), before).otherwise(after))
    return out.withColumn(name, filled).drop("_i", "_p", "_f", "_l", "_f2", "_l2")


def dominant_frequency(df: DataFrame, column: str, ids: Sequence[str], order: str = FRAME, rate: float = FPS) -> DataFrame:
    """The frequency with the largest magnitude in the discrete Fourier transform of each id's values, the mean taken out; one small kernel per id."""
    import numpy as np
    import pandas as pd

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_at")["_x"].dropna().to_numpy(float)
        f = float(np.fft.rfftfreq(len(x), 1 / rate)[np.abs(np.fft.rfft(x - x.mean())).argmax()]) if len(x) else None
        return pdf[list(ids)].head(1).assign(frequency=f)

    rows = df.select(*ids, F.col(order).alias("_at"), F.col(column).cast("double").alias("_x"))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*ids).dtypes)
    return rows.groupBy(*ids).applyInPandas(peak, f"{fields}, frequency double")
