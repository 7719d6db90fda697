"""Results of functions kept as parquet."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def cached(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Adds cache_path and cache_overwrite to a function (spark, ...) -> DataFrame: what lies at the path is read, else computed and written there first."""

    @wraps(f)
    def run(spark: SparkSession, *args, cache_path: str | None = None, cache_overwrite: bool = False, **options) -> DataFrame:
        if cache_path is None:
            return f(spark, *args, **options)
        if not cache_overwrite:
            try:
                return spark.read.parquet(cache_path)
            except AnalysisException:
                pass
        f(spark, *args, **options).write.mode("overwrite").parquet(cache_path)
        return spark.read.parquet(cache_path)

    return run
