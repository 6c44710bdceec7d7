"""Sharding by bytes: global prefix sums of sizes, cut at equal targets into contiguous balanced shards.

DataFrame operations only.  The global order is by digest of the text, then by id range and id, so equal texts lie side by
side.  Prefix sums come from per-partition totals in three bounded steps: totals of 4096 digest ranges, groups of equal
texts inside a range, and ``SPLITS`` id ranges inside a group.  So no window holds more than a range of groups, and a group
with a third of all rows is split into as many.  Texts are read once; what follows sees ids, sizes and digests.

``tolerance`` is how much balance may be given up, as a share of a shard, to keep equal texts together: a group of at most
that many bytes goes whole to the shard of its middle; in larger ones every row goes to the shard of its own middle, so
that at most one group is cut at each border.

Defined results: null text has size ``overhead`` and the checksum of no bytes is null -> 0; a null id sorts first
among copies; rows that repeat id and text take neighbouring slots; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_column, null_again, written

#: Hexadecimal digits of a digest that make its range: 4096 ranges.
RANGE_DIGITS = 3
#: Id ranges of a group of equal texts.
SPLITS = 1024
#: A prime by which ids are spread over the ranges, whatever step they have.
SPREAD = 1_000_003
TOLERANCE = 1 / 64


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 inside a shard)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        id_column(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("digest")
    )
    rows = written(rows.withColumns({"range": F.substring("digest", 1, RANGE_DIGITS), "split": F.pmod(F.pmod("id", F.lit(SPREAD)), F.lit(SPLITS)).cast("int")}), "sizes")
    group = ["range", "digest"]
    first = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    splits = rows.groupBy(*group, "size", "split").agg(F.count("*").alias("n")).withColumn("split_at", before("n", first(*group).orderBy("split")))
    groups = splits.groupBy(*group, "size").agg(F.sum("n").alias("group_n")).withColumn("group_bytes", F.col("group_n") * F.col("size"))
    in_range = first("range").orderBy("digest")
    groups = groups.withColumns({"rows_at": before("group_n", in_range), "bytes_at": before("group_bytes", in_range)})
    ranges = groups.groupBy("range").agg(F.sum("group_n").alias("range_n"), F.sum("group_bytes").alias("range_bytes"))  # 4096 rows at most
    over_all = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range", before("range_n", over_all).alias("range_rows_at"), before("range_bytes", over_all).alias("range_bytes_at"), F.sum("range_bytes").over(every).alias("all_bytes")
    )
    placed = (
        rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "split").orderBy("id")) - 1)
        .join(splits.drop("n", "size"), [*group, "split"])
        .join(groups.drop("size"), group)
        .join(F.broadcast(ranges), "range")
    )
    target = F.col("all_bytes") / shards
    copy_at = F.col("split_at") + F.col("nth")
    group_at = F.col("range_bytes_at") + F.col("bytes_at")
    whole, own = group_at + F.col("group_bytes") / 2, group_at + copy_at * F.col("size") + F.col("size") / 2
    middle = F.when(F.col("group_bytes") <= target * tolerance, whole).otherwise(own)
    placed = placed.select(
        "id", "size", "crc", (F.col("range_rows_at") + F.col("rows_at") + copy_at).alias("place"), F.least(F.floor(middle / target), F.lit(shards - 1)).cast("int").alias("shard")
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    out = placed.join(F.broadcast(starts), "shard")
    return out.select(null_again("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("start")).cast("long").alias("slot"))
