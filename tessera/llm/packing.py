"""Best-fit packing by minimum bin slack.

How full sequences can be filled depends only on how many pieces there are of each length, at most ``capacity``
numbers.  These come to the driver.  There each step takes the longest piece left and, with a bitset in which bit s
says that lengths adding up to s are available, finds the fullest combination with it; that combination is taken out
as often as the counts allow, which uses up a length, so the steps are few however many pieces there are.  The plan
is then a short list of slot ranges for each length.  A piece finds its slot by its rank among those of its length:
tasks number their own pieces while cutting them, and the sums over tasks before it are taken in a window for each
length, which holds a row per task.  Nothing is sorted and no text moves.

Defined results: a null text is empty; every document ends with the end id, so an empty one is one piece of length 1;
null ids stay null; repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_bpe
from .common import lean, written

END_ID = 0


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each as often as ``counts`` at most, that add up to the largest sum that is at most ``room``."""
    bits, mask = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int]] = []  # (length, sums that were reachable before it was added once more)
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (bits | bits << length) & mask
            if more == bits:
                break
            steps.append((length, bits))
            bits = more
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    out = []
    for length, before in reversed(steps):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences)."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {n: c for n, c in left.items() if c and n <= capacity - longest}
        left[longest] += 1
        combination = [longest, *fullest(rest, capacity - longest)]
        need = {n: combination.count(n) for n in set(combination)}
        times = min(left[n] // k for n, k in need.items())
        out.append((combination, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(sequences: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, pieces in a sequence, first sequence, place of the first piece)."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for lengths, times in sequences:
        at = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            out.setdefault(n, []).append((ranks.get(n, 0), k, base, at))
            ranks[n] = ranks.get(n, 0) + k * times
            at += k * n
        base += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place(found: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                k = np.flatnonzero(length == n)
                row = found[int(n)][np.searchsorted(found[int(n)][:, 0], rank[k], "right") - 1]
                nth = rank[k] - row[:, 0]
                sequence[k], offset[k] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * n
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def _cut(make: Callable[[], Callable[[bytes], bytes]], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = make(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or b"") + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    rows.append((doc, piece, start, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    cut = _cut(lambda: word_bpe.load(path).encode, capacity)
    pieces = written(rows.mapInArrow(lean(cut), "doc long, piece int, start long, length long, ids_crc32 long, task long, nth long"), "pieces")
    totals = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "totals")
    counts = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    # the totals have a row for each task and length, so they are joined by sorting and never broadcast
    ranked = pieces.join(totals.drop("n").hint("merge"), ["task", "length"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(_place(slots(plan(counts, capacity))), "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)
