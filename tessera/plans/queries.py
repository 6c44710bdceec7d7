"""The registered queries of the document engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import compile_filter, typed
from ..operators import catalog, merge, reads
from ..sources.store import dump_lines, restore_rows
from ..streaming import fold as streaming
from . import store_queries
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def _find(name: str, filter_: dict) -> Query:
    return lambda spark, d: reads.find(table(spark, d, name), filter_)


def _live(rows: DataFrame) -> DataFrame:
    return merge.latest_by_key(rows, ["user_id"], ["event_id"], F.col("event_type") == "error")


def merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    return _live(table(spark, d, "events"))


def find_capped(spark: SparkSession, d: str) -> DataFrame:
    part = reads.with_id(table(spark, d, "part"), "p_partkey")
    return reads.capped(part.where(compile_filter({"p_retailprice": {"$gt": 950}}, typed(part.schema))))


def find_one(spark: SparkSession, d: str) -> DataFrame:
    return reads.find_one(table(spark, d, "orders"), "42", "o_orderkey")


def _json(filter_: dict) -> Query:
    return lambda spark, d: reads.find_json(table(spark, d, "events"), "props", filter_).select("event_id", "props")


def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return reads.scan_prefix(table(spark, d, "events"), "event_type", "p")


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_SEQ = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest_by_key(table(spark, d, "lineitem"), ["l_orderkey"], LINE_SEQ)


def upsert_many(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    changes = orders.where("o_orderkey % 10 = 3").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2})
    return merge.upsert(orders, changes, ["o_orderkey"])


def update_set(spark: SparkSession, d: str) -> DataFrame:
    return merge.apply_set(table(spark, d, "customer"), F.col("c_custkey") == 7, {"c_mktsegment": "UPDATED"})


def delete_keys(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return merge.delete_keys(orders, reads.find(orders, {"o_orderstatus": "F"}), ["o_orderkey"])


def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    docs = nation.select(F.lit("nation").alias("collection"), F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct(*nation.columns)).alias("doc"))
    path = scratch(spark)
    dump_lines(docs).write.text(path)
    doc = F.from_json("doc", nation.schema)
    return restore_rows(spark, path).select(doc.alias("doc")).select("doc.*")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def collections(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collections(merge.union_runs([table(spark, d, n).select(F.lit(n).alias("collection")) for n in NAMES])).orderBy("name")


def distinct_collections(spark: SparkSession, d: str) -> DataFrame:
    return catalog.distinct_collections(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderkey"))


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.run_stats(table(spark, d, "events"), F.floor(F.col("event_id") / 1000).cast("long"), "user_id")


def run_overlap(spark: SparkSession, d: str) -> DataFrame:
    runs = run_stats(spark, d)
    return catalog.run_overlap(runs.where("run % 2 = 0"), runs.where("run % 2 = 1"))


def level_metrics(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select((F.col("p_size") % 2).cast("int").alias("level"), F.col("p_partkey").alias("bytes"))
    return catalog.level_metrics(files)


def tombstone_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tombstone_counts(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error")


def expected_keys(spark: SparkSession, d: str) -> DataFrame:
    return catalog.expected_keys(run_stats(spark, d))


def file_set_difference(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return catalog.file_difference(part, part.where("p_partkey % 3 = 0"), "p_partkey")


def rolling_30(spark: SparkSession, d: str) -> DataFrame:
    return catalog.rolling(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


def key_listing(spark: SparkSession, d: str) -> DataFrame:
    return reads.keys(table(spark, d, "lineitem"), F.concat_ws(":", F.lit("line"), F.col("l_orderkey").cast("string")), 5000)


def compaction_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Runs are compacted by fives, tombstones kept, and merged again."""
    events = table(spark, d, "events").withColumn("run", F.pmod(F.floor(F.col("event_id") / 1000), F.lit(5)))
    compacted = merge.latest_by_key(events, ["user_id", "run"], ["event_id"]).drop("run")
    return _live(compacted.select(*events.drop("run").columns))


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """The changelog read as a stream; the state's columns come back in the table's order."""
    events, at = table(spark, d, "events"), scratch(spark)
    source = scratch(spark)
    events.repartitionByRange(4, "event_id").write.parquet(source)
    changes = streaming.read_changes(spark, source, events.schema, files_per_trigger=1)
    streaming.fold(changes, ["user_id"], ["event_id"], f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return streaming.live(streaming.latest_state(spark, f"{at}/state", ["user_id"], ["event_id"]), F.col("event_type") == "error").select(*events.columns)


def queries() -> dict[str, Query]:
    return {
        "find_eq_string": _find("orders", {"o_orderstatus": "F"}),
        "find_eq_number": _find("part", {"p_size": 15}),
        "find_gt": _find("part", {"p_retailprice": {"$gt": 950.5}}),
        "find_lt": _find("part", {"p_retailprice": {"$lt": 1000}}),
        "find_range": _find("lineitem", {"l_quantity": {"$gt": 10, "$lt": 20}}),
        "find_in_and_gt": _find("customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"$gt": 0}}),
        "find_in_number": _find("part", {"p_size": {"$in": [1, 5, 9]}}),
        "find_in_with_null": _find("part", {"p_size": {"$in": [2, None, "2"]}}),
        "find_empty_filter": _find("nation", {}),
        "find_empty_operator_map": _find("nation", {"n_name": {}}),
        "find_unknown_operator": _find("region", {"r_regionkey": {"$gte": 1}}),
        "find_gt_nonnumeric_operand": _find("customer", {"c_acctbal": {"$gt": "abc"}}),
        "find_gt_on_string": _find("nation", {"n_name": {"$gt": 1}}),
        "find_missing_is_null": _find("region", {"nope": None}),
        "find_operator_case": _find("part", {"p_size": {"$GT": 40, "$Lt": 45}}),
        "find_capped": find_capped,
        "find_one": find_one,
        "json_gt": _json({"k": {"$gt": 50}}),
        "json_range": _json({"k": {"$gt": 20, "$lt": 40}}),
        "json_in": _json({"k": {"$in": [1, 2, "3"]}}),
        "scan_prefix": scan_prefix,
        "key_listing": key_listing,
        "merge_on_read": merge_on_read,
        "dedup_latest": dedup_latest,
        "upsert_many": upsert_many,
        "update_set": update_set,
        "delete_keys": delete_keys,
        "restore_roundtrip": restore_roundtrip,
        "collections": collections,
        "distinct_collections": distinct_collections,
        "run_stats": run_stats,
        "run_overlap": run_overlap,
        "level_metrics": level_metrics,
        "tombstone_counts": tombstone_counts,
        "expected_keys": expected_keys,
        "file_set_difference": file_set_difference,
        "rolling_30": rolling_30,
        "compaction_equivalence": compaction_equivalence,
        "stream_fold": stream_fold,
        **store_queries.queries(),
    }


_LIVE = """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"""
_RUNS = "SELECT CAST(floor(event_id / 1000.0) AS BIGINT) AS run, min(user_id) AS min_key, max(user_id) AS max_key, count(*) AS key_count FROM events GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    return {
        "find_eq_string": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
        "find_eq_number": "SELECT * FROM part WHERE p_size = 15",
        "find_gt": "SELECT * FROM part WHERE p_retailprice > 950.5",
        "find_lt": "SELECT * FROM part WHERE p_retailprice < 1000",
        "find_range": "SELECT * FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20",
        "find_in_and_gt": "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0",
        "find_in_number": "SELECT * FROM part WHERE p_size IN (1, 5, 9)",
        "find_in_with_null": "SELECT * FROM part WHERE p_size = 2 OR p_size IS NULL",
        "find_empty_filter": "SELECT * FROM nation",
        "find_empty_operator_map": "SELECT * FROM nation",
        "find_unknown_operator": "SELECT * FROM region WHERE false",
        "find_gt_nonnumeric_operand": "SELECT * FROM customer WHERE c_acctbal > 0",
        "find_gt_on_string": "SELECT * FROM nation WHERE false",
        "find_missing_is_null": "SELECT * FROM region",
        "find_operator_case": "SELECT * FROM part WHERE p_size > 40 AND p_size < 45",
        "find_capped": "SELECT CAST(p_partkey AS VARCHAR) AS _id, * FROM part WHERE p_retailprice > 950 ORDER BY 1 LIMIT 1000",
        "find_one": "SELECT * FROM orders WHERE o_orderkey = 42",
        "json_gt": f"SELECT event_id, props FROM events WHERE {k} > 50",
        "json_range": f"SELECT event_id, props FROM events WHERE {k} > 20 AND {k} < 40",
        "json_in": f"SELECT event_id, props FROM events WHERE {k} IN (1, 2)",
        "scan_prefix": "SELECT * FROM events WHERE starts_with(event_type, 'p')",
        "key_listing": "SELECT DISTINCT 'line:' || CAST(l_orderkey AS VARCHAR) AS key FROM lineitem ORDER BY 1 LIMIT 5000",
        "merge_on_read": _LIVE,
        "dedup_latest": f"SELECT {', '.join(LINE)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_SEQ)}) AS rn FROM lineitem) WHERE rn = 1",
        "upsert_many": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY run DESC) AS rn FROM (
            SELECT *, 0 AS run FROM orders UNION ALL
            SELECT o_orderkey, o_custkey, 'X', o_totalprice * 2, o_orderdate, o_orderpriority, 1 FROM orders WHERE o_orderkey % 10 = 3)) WHERE rn = 1""",
        "update_set": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = 7 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
        "delete_keys": "SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_orderstatus = 'F' AND g.o_orderkey = o.o_orderkey)",
        "restore_roundtrip": "SELECT * FROM nation",
        "collections": "SELECT name, count(*) AS docCount, CAST(0 AS BIGINT) AS byteSize FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name FROM {n}" for n in NAMES) + ") GROUP BY name ORDER BY name",
        "distinct_collections": "SELECT DISTINCT o_orderpriority AS collection FROM (SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10000)",
        "run_stats": _RUNS,
        "run_overlap": f"""WITH r AS ({_RUNS}) SELECT a.run AS a_run, a.min_key AS a_min_key, a.max_key AS a_max_key, a.key_count AS a_key_count,
          b.run AS b_run, b.min_key AS b_min_key, b.max_key AS b_max_key, b.key_count AS b_key_count
          FROM r a JOIN r b ON b.max_key >= a.min_key AND b.min_key <= a.max_key WHERE a.run % 2 = 0 AND b.run % 2 = 1""",
        "level_metrics": """SELECT CAST(l.level AS INTEGER) AS level, count(p.p_partkey) AS files, CAST(coalesce(sum(p.p_partkey), 0) AS BIGINT) AS bytes
          FROM range(3) l(level) LEFT JOIN part p ON p.p_size % 2 = l.level GROUP BY 1""",
        "tombstone_counts": "SELECT user_id, count(*) FILTER (event_type = 'error') AS tombstones, count(*) FILTER (event_type <> 'error') AS live_values, count(*) AS entries FROM events GROUP BY user_id",
        "expected_keys": f"SELECT CAST(floor(sum(key_count) * 1.1) AS BIGINT) AS expected FROM ({_RUNS})",
        "file_set_difference": "SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM part g WHERE g.p_partkey % 3 = 0 AND g.p_partkey = p.p_partkey)",
        "rolling_30": "SELECT event_id, user_id, value, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling_avg FROM events",
        "compaction_equivalence": _LIVE,
        "stream_fold": _LIVE,
        **store_queries.oracle_sql(),
    }
