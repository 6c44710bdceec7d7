"""Keys that hold a large share of all rows, found in one pass with bounded memory.

Each task keeps a summary of at most ``most`` keys: where more are seen, the next largest count is taken off all and
what falls to zero leaves.  A task's counts are too small by at most its rows over ``most``, so their sums are too small
by at most all rows over ``most``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Summary:
    def __init__(self, most: int):
        self.most, self.seen = most, 0
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.seen += len(keys)
        new, times = np.unique(keys, return_counts=True)
        key, place = np.unique(np.r_[self.key, new], return_inverse=True)
        n = np.bincount(place, np.r_[self.n, times], len(key)).astype(np.int64)
        if len(key) > self.most:
            n -= np.partition(n, len(n) - self.most - 1)[len(n) - self.most - 1]
            key, n = key[n > 0], n[n > 0]
        self.key, self.n = key, n


def _summaries(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summary(most)
        for b in batches:
            if b.num_rows:
                s.add(b.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([*s.key.tolist(), None], pa.int64()), pa.array([*s.n.tolist(), s.seen], pa.int64())], names=["key", "n"])

    return run


def heavy_keys(keys: DataFrame, least: int, most: int | None = None) -> np.ndarray:
    """Sorted keys of the one long column of ``keys`` (without nulls): every key with ``2 / most`` of all rows is
    among them if ``least`` rows or more hold it beyond what the summaries may miss; never more than ``most`` keys, which is the number of
    shuffle partitions, 256 at least: a key that isn't among them holds at most about two partitions' share of the rows."""
    most = most or max(256, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = keys.mapInArrow(_summaries(most), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # the row without a key counts all rows, so it is the first; at most ``most`` keys hold one part in ``most`` of them
    top = found.orderBy(F.desc("n"), F.col("key").isNotNull()).limit(most + 1).collect()
    total = next((r.n for r in top if r.key is None), 0)
    return np.array(sorted(r.key for r in top if r.key is not None and r.n * most >= total and r.n >= least), np.int64)
