"""Connected components by alternating stars, in DataFrame operations; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Edges of a partition that is written, so that small rounds write few files.
EDGES = 1 << 19
#: Parts into which the neighbours of a node are dealt, so that no task holds a hub with all of them.
PARTS = 64


def _with_minimum(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least v of their u.  Minima are taken for each part of a node's neighbours first, and
    each part is joined with the minimum of all; a node has at most ``PARTS`` rows in the window in between."""
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part")
    least = rows.groupBy("u", part).agg(F.min("v").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return rows.select("u", "v", part).join(least, ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) -> (node, root): root is the smallest node that can be reached.  Nodes without edges are left out.

    Large star: a node's larger neighbours are tied to its smallest neighbour.  Small star: its smaller neighbours
    and itself are.  Minima are combined before the shuffle, and the edges of a hub meet its minimum in ``PARTS`` parts.  It
    ends when a round changes nothing.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        tied = _with_minimum(large)  # every node is tied to its least one, and so are its others
        small = tied.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a round makes at most twice as many edges as it was given
        old, e = e, written(small.distinct().coalesce(max(1, 2 * state[0] // EDGES)), "edges")
        discard(old)
        if (now := _state(e)) == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
