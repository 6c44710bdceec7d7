"""Shared pieces of the training-data operators: tables, written stages, null-safe ids."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, so that ids stay integers; null ids sort first.
NULL_ID = -(2**63)

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of text that a Python worker takes up at once.
TEXTS = 1024


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = TEXTS) -> Callable:
    """``run`` over slices of ``rows`` rows; at the end of the task the memory that allocators hold goes back.

    Workers serve many tasks, so what one task needed at its peak would otherwise stay with the worker.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from [b] if rows is None or b.num_rows <= rows else (b.slice(at, rows) for at in range(0, b.num_rows, rows))

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts(batches))
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return lean_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def null_again(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a new one is made in local mode only, where there is one machine; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    The files outlive any executor, and what follows never recomputes ``df``.  They go when the application ends, or
    with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of queries that are done: Spark deletes them only when the driver's garbage is collected,
    which may take long while the executors do all the work.  Twice, as listeners hold a query for a moment."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    fs, place = _place(df.sparkSession, df.written_at)
    fs.delete(place, True)
