"""Catalog and storage aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 3


def collections(rows: DataFrame) -> DataFrame:
    """(collection, ...) -> name, docCount, byteSize (always 0)."""
    return rows.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("docCount")).withColumn("byteSize", F.lit(0).cast("long"))


def distinct_collections(rows: DataFrame, collection: Column, key: Column, first: int = 10_000) -> DataFrame:
    """Collections among the first keys: what completion looks at."""
    return rows.select(collection.alias("collection"), key.alias("key")).orderBy("key").limit(first).select("collection").distinct()


def run_stats(rows: DataFrame, run: Column, key: str) -> DataFrame:
    return rows.groupBy(run.alias("run")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("key_count"))


def run_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet.  Runs are files of a manifest, a few thousand at most; documents never come here."""
    a, b = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)), b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    return a.join(b, (F.col("b_max_key") >= F.col("a_min_key")) & (F.col("b_min_key") <= F.col("a_max_key")))


def level_metrics(files: DataFrame) -> DataFrame:
    """(level, bytes) -> files and bytes of each level, zero where a level is empty."""
    levels = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    found = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return levels.join(found, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def total_bytes(levels: DataFrame) -> DataFrame:
    """(level, files, bytes) -> the bytes of all levels."""
    return levels.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def named_like(names: DataFrame, term: str, column: str = "name") -> DataFrame:
    """Rows whose name holds the term, whatever its case."""
    return names.where(F.lower(column).contains(term.lower()))


def last_samples(samples: DataFrame, order: str, n: int = 30) -> DataFrame:
    """The newest n samples, which is all a chart of the last ones shows; oldest first."""
    return samples.orderBy(F.desc(order)).limit(n).orderBy(order)


def record_count(response: DataFrame, column: str) -> DataFrame:
    """How many records each JSON response holds: the length of an array, 1 for anything else, 0 for null."""
    v = F.try_parse_json(column)
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    return response.withColumn("records", F.when(v.isNull() | F.is_variant_null(v), 0).when(F.schema_of_variant(v).startswith("ARRAY"), size).otherwise(1))


def tombstone_counts(rows: DataFrame, keys: list[str], tombstone: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(tombstone).alias("tombstones"), F.count_if(~tombstone).alias("live_values"), F.count("*").alias("entries"))


def expected_keys(files: DataFrame) -> DataFrame:
    """Room for a merged file's keys: their sum and a tenth."""
    return files.agg(F.floor(F.sum("key_count") * 1.1).alias("expected"))


def file_difference(files: DataFrame, removed: DataFrame, path: str) -> DataFrame:
    return files.join(removed.select(path), path, "left_anti")


def rolling(rows: DataFrame, partition: list[str], order: str, value: str, n: int = 30) -> DataFrame:
    """Average of the last n samples of each series."""
    last = Window.partitionBy(*partition).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("rolling_avg", F.round(F.avg(value).over(last), 6))
