"""Scalar helpers of the document store, as Catalyst expressions where they touch data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(collection: Column, id_: Column) -> Column:
    return F.concat_ws(":", collection, id_)


def key_collection(key: Column) -> Column:
    """Before the first colon; null where there is none."""
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1))


def key_id(key: Column) -> Column:
    at = F.instr(key, ":")
    return F.when(at > 0, F.substr(key, at + 1))


def run_file_name(level: Column, number: Column) -> Column:
    return F.format_string("L%d_%06d", level, number)


def run_level(name: Column) -> Column:
    return F.regexp_extract(name, r"^L(\d+)_(\d+)", 1).cast("int")


def run_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^L(\d+)_(\d+)", 2).cast("long")


def percent_of(value: Column, capacity: float) -> Column:
    return F.least(value / F.lit(capacity) * 100, F.lit(100.0))


def human_bytes(size: Column) -> Column:
    unit = F.when(size <= 0, 0).otherwise(F.least(F.floor(F.log(2.0, size) / 10), F.lit(4))).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1)
    return F.concat_ws(" ", F.round(size / F.pow(F.lit(1024.0), unit), 2).cast("string"), name)


def complete(words: list[str], typed: str) -> list[str]:
    """Case-insensitive completion."""
    return [w for w in words if w.lower().startswith(typed.lower())]
