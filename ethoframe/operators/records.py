"""Maps compared with one another: records of a group are rows with a map; keys and values become rows, so no record is compared with each other one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoframe.frames import same


def key_agreement(records: DataFrame, groups: Sequence[str], record: str, column: str) -> DataFrame:
    """groups, key, n_holding, shared, common, variable, owner: how the maps of a group agree on each key that any of them holds.

    Shared keys stand in all maps of the group (null and empty maps hold none), common ones with one value, where nulls equal each other, and variable ones with
    several. owner is the record of a key that one map alone holds. A group whose maps are all empty has no row.
    """
    groups = list(groups)
    totals = records.groupBy(*groups).agg(F.count("*").alias("_records"))
    entries = records.select(*groups, F.col(record).alias("_record"), F.explode(column).alias("key", "_value"))
    keys = entries.groupBy(*groups, "key").agg(
        F.count("*").alias("n_holding"), F.count("_value").alias("_known"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.min("_record").alias("_owner")
    )
    joined = keys.join(totals, same(keys, totals, groups)).select(*(keys[c] for c in groups), *(c for c in keys.columns if c not in groups), "_records")
    one = (F.col("_known") == 0) | ((F.col("_known") == F.col("n_holding")) & (F.col("_lo") == F.col("_hi")))
    shared = F.col("n_holding") == F.col("_records")
    owner = F.when(F.col("n_holding") == 1, F.col("_owner"))
    return joined.select(*groups, "key", "n_holding", shared.alias("shared"), (shared & one).alias("common"), (shared & ~one).alias("variable"), owner.alias("owner"))


def values_by_key(records: DataFrame, groups: Sequence[str], record: str, column: str) -> DataFrame:
    """groups, key, values: the values that the group's maps give a key, in the order of the records; maps without the key are left out, null values are kept."""
    entries = records.select(*groups, F.col(record).alias("_record"), F.explode(column).alias("key", "_value"))
    in_order = F.array_sort(F.collect_list(F.struct("_record", "_value")))
    return entries.groupBy(*groups, "key").agg(F.transform(in_order, lambda x: x["_value"]).alias("values"))
