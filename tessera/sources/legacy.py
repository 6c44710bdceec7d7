"""Importer of the old key-value files: entries of (key size, value size: int32 little-endian; key; value)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_collection, key_id
from ..operators.merge import latest_by_key
from .files import Files


def entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        k, v = struct.unpack_from("<ii", data, at)
        if k < 0 or v < 0 or at + 8 + k + v > len(data):
            return  # a torn end
        yield data[at + 8 : at + 8 + k], data[at + 8 + k : at + 8 + k + v]
        at += 8 + k + v


def entry_bytes(key: bytes, value: bytes) -> bytes:
    return struct.pack("<ii", len(key), len(value)) + key + value


def write_entries(path: str, rows: list[tuple[bytes, bytes]]) -> None:
    with open(path, "ab") as f:
        f.writelines(entry_bytes(k, v) for k, v in rows)


def read_entry_at(spark: SparkSession, path: str, offset: int) -> tuple[bytes, bytes, int] | None:
    """Key, value and end of the entry that starts at a place of a file; None where no whole entry does."""
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder)
    head = files.read(name, offset, 8)
    if offset < 0 or len(head) < 8:
        return None
    k, v = struct.unpack("<ii", head)
    body = files.read(name, offset + 8, k + v) if k >= 0 and v >= 0 else b""
    return (body[:k], body[k:], offset + 8 + k + v) if k >= 0 and v >= 0 and len(body) == k + v else None


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(collection, _id, doc, file, ord): files by name, ``ord`` counts the entries of each; keys without a colon are skipped.
    Files are read in parallel, one of them as a whole in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(entries(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array([k.decode(errors="replace") for k, _ in found], pa.string()), pa.array([v.decode(errors="replace") for _, v in found], pa.string()), pa.array(range(len(found)), pa.int64())],
                    names=["file", "key", "doc", "ord"],
                )

    rows = spark.read.format("binaryFile").load(path).select("content", "path").mapInArrow(run, "file string, key string, doc string, ord long")
    return rows.select(key_collection(F.col("key")).alias("collection"), key_id(F.col("key")).alias("_id"), "doc", "file", "ord").where(F.col("collection").isNotNull())


def migrate(store, path: str) -> int:
    """All entries in one commit; later ones of a key win, in the order of file names and of entries in a file."""
    rows = latest_by_key(read_legacy(store.spark, path), ["collection", "_id"], ["file", "ord"])
    return store.commit(rows.drop("file").withColumn("tombstone", F.lit(False)))
