"""Frame tables made of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoframe.frames import FRAME, frame_numbers
from ethoframe.operators import bouts, runs

IDS = ["user_id"]
LABELS = ["click", "error", "purchase", "signup", "view"]
FPS = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, frame_index (1 ... by time), event_type, value, x, y."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    numbered = frame_numbers(rows, IDS, ["ts", "event_id"]).drop("ts")
    return numbered.withColumns({"x": F.col("value"), "y": F.pmod("event_id", F.lit(97)).cast("double"), "sparse": F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("value"))})


def event_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bouts.label_bouts(events(spark, sf_dir), "event_type", IDS)


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_length_encode(events(spark, sf_dir), "event_type", IDS)


def r6(column: str | Column) -> Column:
    """Rounded for a comparison that does not depend on the order of sums; never -0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6) + F.lit(0.0)


#: The same tables as common table expressions: e, r (runs with their number), runs, b (bouts).
E = """e AS (
  SELECT event_id, user_id, event_type, value, value AS x, CAST(event_id % 97 AS DOUBLE) AS y,
         CASE WHEN event_id % 7 <> 0 THEN value END AS sparse,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_index
  FROM events)"""
RUNS = (
    E
    + """, g AS (
  SELECT *, sum(CASE WHEN f = 1 OR NOT (event_type IS NOT DISTINCT FROM before) THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY frame_index) AS run
  FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))),
runs AS (
  SELECT user_id, min(frame_index) AS start_index, max(frame_index) AS end_index,
         CAST(max(frame_index) - min(frame_index) + 1 AS BIGINT) AS run_length, any_value(event_type) AS run_value
  FROM g GROUP BY user_id, run)"""
)
BOUTS = RUNS + ", b AS (SELECT user_id, start_index AS frame_index, end_index AS end_frame, run_length AS bout_length, run_value AS behavior_name FROM runs WHERE run_value IS NOT NULL)"


def sql(cte: str, body: str) -> str:
    return f"WITH {cte} {body}"


__all__ = ["BOUTS", "E", "FPS", "FRAME", "IDS", "LABELS", "RUNS", "event_bouts", "event_runs", "events", "r6", "sql", "table"]
