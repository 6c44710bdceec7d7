"""Reads of collections: filtered scans, the first documents in id order, point reads, key listings."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_filter, typed, variant

CAP = 1000


def with_id(df: DataFrame, key: str) -> DataFrame:
    """A table as a collection: its key as the string ``_id``."""
    return df.select(F.col(key).cast("string").alias("_id"), *df.columns)


def find(df: DataFrame, filter_: dict[str, Any] | None, extended: bool = False) -> DataFrame:
    return df.where(compile_filter(filter_, typed(df.schema), extended))


def matches_json(json_col: str, filter_: dict[str, Any] | None, extended: bool = False) -> Column:
    """Whether a JSON column holds a document that the filter matches; broken JSON never does.

    The document is the variable of a lambda, so that it is parsed once a row however many terms the filter has.
    """
    one = lambda v: F.coalesce(v.isNotNull() & compile_filter(filter_, variant(v), extended), F.lit(False))
    return F.exists(F.array(F.try_parse_json(F.col(json_col))), one)


def find_json(df: DataFrame, json_col: str, filter_: dict[str, Any] | None, extended: bool = False) -> DataFrame:
    """Schemaless documents in a JSON column; broken JSON is skipped."""
    return df.where(matches_json(json_col, filter_, extended))


def capped(df: DataFrame, limit: int = CAP) -> DataFrame:
    """The first documents in id order: a top-k, which is the feature of every listing."""
    return df.orderBy("_id").limit(limit)


def find_one(df: DataFrame, id_: str, key: str | None = None) -> DataFrame:
    """A point read.  With ``key`` the id is compared in the key column's own type, which reaches the scan."""
    if key is None:
        return df.where(F.col("_id") == id_)
    own = F.lit(id_).try_cast(df.schema[key].dataType)
    return df.where((F.col(key) == own) & (own.cast("string") == id_))


def scan_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def keys(df: DataFrame, key: Column, limit: int = 0) -> DataFrame:
    found = df.select(key.alias("key")).distinct().orderBy("key")
    return found.limit(limit) if limit else found
