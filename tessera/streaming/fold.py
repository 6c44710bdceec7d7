"""The changelog as a stream: rows with deletes, folded into the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import latest_by_key
from ..sources.files import Files


def read_changes(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """``files_per_trigger`` is the back-pressure: what waits stays in the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Batches whose changes are merged into one state.
MERGED = 10


def fold(changes: DataFrame, keys: list[str], seq: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest version of each key, tombstones included.

    A batch appends only its own newest versions (``state/batch=N``); each ``MERGED``-th merges all before it into one
    state (``state/base=N``), after which those are deleted.  A replayed batch overwrites its own changes, and is skipped
    where a state holds it already.
    """
    spark = changes.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        files = Files(spark, state)
        base, since = _parts(files)
        if number <= base:
            return
        own = latest_by_key(batch, keys, seq)
        own.write.mode("overwrite").parquet(f"{state}/batch={number:012d}")
        if number % MERGED == MERGED - 1:
            merged = latest_state(spark, state, keys, seq)
            merged.select(*batch.columns).write.mode("overwrite").parquet(f"{state}/base={number:012d}")
            for n in since:
                files.delete(f"batch={n:012d}")
            files.delete(f"batch={number:012d}")
            if base >= 0:
                files.delete(f"base={base:012d}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(files: Files) -> tuple[int, list[int]]:
    """The batch up to which the newest state is merged (-1: none), and the batches after it."""
    done = [n for n in files.names("") if "=" in n and "_SUCCESS" in files.names(n)]
    base = max((int(n.partition("=")[2]) for n in done if n.startswith("base=")), default=-1)
    return base, sorted(k for n in done if n.startswith("batch=") and (k := int(n.partition("=")[2])) > base)


def latest_state(spark: SparkSession, state: str, keys: list[str], seq: list[str]) -> DataFrame | None:
    """The newest version of each key, tombstones included: state and later changes, merged on read."""
    base, since = _parts(Files(spark, state))
    paths = [f"{state}/base={base:012d}"] * (base >= 0) + [f"{state}/batch={n:012d}" for n in since]
    return latest_by_key(spark.read.parquet(*paths), keys, seq) if paths else None


def live(state: DataFrame, tombstone: Column) -> DataFrame:
    return state.where(~F.coalesce(tombstone, F.lit(False)))
