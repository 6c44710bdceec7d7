"""Newest-wins merge of versioned rows, and the edits that are appended to them.

The merge ranks the versions of a key, newest first, and keeps the first.  Spark plans a group limit before the exchange, so
a key with a third of all versions shuffles one row per task.  Tombstones are dropped after the merge, never before.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], seq: list[str], tombstone: Column | None = None) -> DataFrame:
    """The row with the greatest ``seq`` of each key; keys whose newest row is a tombstone are hidden."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in seq))
    newest = df.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")
    return newest if tombstone is None else newest.where(~F.coalesce(tombstone, F.lit(False)))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` (unique keys) replace those of ``target``."""
    both = union_runs([target.withColumn("_run", F.lit(0)), changes.withColumn("_run", F.lit(1))])
    return latest_by_key(both, keys, ["_run"]).drop("_run")


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti")


def apply_set(df: DataFrame, where: Column, values: dict[str, Any]) -> DataFrame:
    """``$set`` of top-level columns on the rows that match."""
    return df.withColumns({k: F.when(where, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
