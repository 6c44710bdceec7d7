"""Registered queries that drive a store, the shell and the REST gateway over the driver's tables, with their SQL.

Each makes a store of its own in the shared folder.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..http_api import serve
from ..operators import catalog, merge, reads
from ..shell import Shell
from ..sources import legacy
from ..sources.files import Files
from ..sources.generate import COLLECTIONS, load_random
from ..sources.store import Store
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def changed_suppliers(spark: SparkSession, d: str, **options) -> Store:
    """Suppliers, then every third with twice its balance, then every seventh deleted: three runs at least."""
    store, supplier = Store(spark, scratch(spark), **options), table(spark, d, "supplier")
    id_ = F.col("s_suppkey").cast("string")
    store.insert_frame("supplier", supplier.withColumn("_id", id_))
    store.insert_frame("supplier", supplier.where("s_suppkey % 3 = 0").withColumns({"_id": id_, "s_acctbal": F.col("s_acctbal") * 2}))
    gone = supplier.where("s_suppkey % 7 = 0").select(F.lit("supplier").alias("collection"), id_.alias("_id"), F.lit(None).cast("string").alias("doc"))
    store.commit(gone.withColumns({"tombstone": F.lit(True), "ord": F.lit(0).cast("long")}))
    return store


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", SUPPLIER).alias("d")).select("d.*")


def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _columns(changed_suppliers(spark, d).snapshot("supplier"))


def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 into 1 and 1 into 2 as they fall due: the limit of level 1 is one byte."""
    store = changed_suppliers(spark, d, l1_bytes=1)
    store.put("other", "x", {"_id": "x"})
    store.flush()  # the fourth run
    return _columns(store.snapshot("supplier"))


def store_full_compaction(spark: SparkSession, d: str) -> DataFrame:
    store = changed_suppliers(spark, d)
    store.compact(force=True)
    store.vacuum()
    return _columns(store.snapshot("supplier"))


def store_find(spark: SparkSession, d: str) -> DataFrame:
    return _columns(changed_suppliers(spark, d).find("supplier", {"s_acctbal": {"$gt": 1000}, "s_nationkey": {"$in": [1, 2, 3, 5, 7]}}))


def store_get(spark: SparkSession, d: str) -> DataFrame:
    """Point reads: one from a run, one that was changed, one deleted, one unknown, one that is only in the buffer."""
    store = changed_suppliers(spark, d)
    store.put("supplier", "new", {"_id": "new", "s_name": "N"})
    found = [(k, v and json.loads(v)["s_name"]) for k in ("1", "3", "7", "nobody", "new") for v in [store.get("supplier", k)]]
    return spark.createDataFrame(found, "id string, s_name string")


def _nations(spark: SparkSession, d: str) -> list[dict]:
    return [r.asDict() for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows at any scale


def store_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Writes that no run holds come back from the log, in a store that is opened again."""
    root = scratch(spark)
    store = Store(spark, root, flush_entries=8)
    for n in _nations(spark, d):
        store.apply(store.batch().put("nation", str(n["n_nationkey"]), json.dumps(n)).put("nation", "last", json.dumps(n)))
    store.delete("nation", "4")
    again = Store(spark, root)
    return again.snapshot("nation").select("_id", F.get_json_object("doc", "$.n_name").alias("n_name"))


def buffer_scan(spark: SparkSession, d: str) -> DataFrame:
    """What is buffered, in key order, the newest of each key, tombstones too."""
    store = Store(spark, scratch(spark))
    for n in _nations(spark, d):
        store.put(f"r{n['n_regionkey']}", str(n["n_nationkey"]), n)
    for n in range(0, 25, 5):
        store.delete("r0", str(n))
    return store.buffer.frame(spark).select("collection", "_id", F.get_json_object("doc", "$.n_name").alias("n_name"), "tombstone", "ord")


def store_restore(spark: SparkSession, d: str) -> DataFrame:
    """A dump of one object with repeated ids, over documents that are there: the later of each id stays."""
    path, folder = scratch(spark), scratch(spark)
    source = Store(spark, path)
    source.insert_frame("region", table(spark, d, "region").withColumn("_id", F.col("r_regionkey").cast("string")))
    source.dump_object(f"{folder}/a")
    docs = [{"_id": str(k % 3), "r_regionkey": k, "r_name": f"R{k}"} for k in range(9)]
    Files(spark, folder).create("b/repeated.json", json.dumps({"region": docs}).encode())
    store = Store(spark, scratch(spark))
    store.restore(f"{folder}/a")
    store.restore(f"{folder}/b")
    return store.snapshot("region").select("_id", *(F.get_json_object("doc", f"$.{c}").alias(c) for c in ("r_regionkey", "r_name")))


def store_dump_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in each array of a dump of one object; their ids are those of their keys."""
    folder = scratch(spark)
    store = changed_suppliers(spark, d)
    store.insert_many("extra", [{"_id": "1"}, {"_id": "2"}])
    store.dump_object(folder)
    arrays = spark.read.text(folder, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<struct<_id: string>>>")).alias("name", "docs"))
    return arrays.select("name", F.size("docs").alias("n"), F.array_max(F.col("docs._id")).alias("last_id"))


def store_collections(spark: SparkSession, d: str) -> DataFrame:
    store = changed_suppliers(spark, d)
    store.insert_many("b", [{"_id": "1"}, {"_id": "2"}])
    store.put("a", "1", "{}")
    store.put("gone", "1", "{}")
    store.delete("gone", "1")
    return store.collections()


def store_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters and gauges; the bytes of levels depend on the writer and are left out."""
    store = changed_suppliers(spark, d)
    store.put("supplier", "x", {"_id": "x"})
    store.delete("supplier", "y")
    store.get("supplier", "x")
    return spark.createDataFrame([(k, v) for k, v in store.metrics().items() if not k.startswith("level_") or k.endswith("files")], "name string, value long")


def store_generated(spark: SparkSession, d: str) -> DataFrame:
    """Random documents: whether each collection has some, and whether all have their number of fields."""
    store = Store(spark, scratch(spark))
    load_random(store, 800, 1)
    fields = F.size(F.map_keys(F.from_json("doc", "map<string,variant>"))) - 1
    return store.snapshot().groupBy("collection").agg((F.count("*") > 0).alias("some"), F.bool_and(fields.between(8, 16)).alias("sized"))


def legacy_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Two old key-value files, a malformed key and a torn end."""
    folder = scratch(spark)
    rows = [(f"nation:{n['n_nationkey']}".encode(), json.dumps(n).encode()) for n in _nations(spark, d)]
    files = Files(spark, folder)
    files.create("1.db", b"".join(legacy.entry_bytes(k, v) for k, v in [*rows, (b"malformed", b"{}")]))
    late = [(k, v.replace(b"NATION", b"LATE")) for k, v in rows[:10]]
    files.create("2.db", b"".join(legacy.entry_bytes(k, v) for k, v in late) + b"\x05\x00\x00\x00torn")
    store = Store(spark, scratch(spark))
    legacy.migrate(store, folder)
    return store.snapshot().select("collection", "_id", F.get_json_object("doc", "$.n_name").alias("n_name"))


def key_helpers(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    key = text.composite_key(F.col("p_brand"), F.concat_ws(":", F.lit("k"), F.col("p_partkey").cast("string")))
    name = text.run_file_name(F.pmod("p_partkey", F.lit(3)).cast("int"), F.col("p_partkey"))
    return part.select(
        "p_partkey", key.alias("key"), text.key_collection(key).alias("collection"), text.key_id(key).alias("id"), name.alias("file"), text.run_level(name).alias("level"),
        text.run_number(name).alias("number"), text.percent_of(F.col("p_size").cast("double"), 40.0).alias("percent"), text.key_collection(F.col("p_brand")).alias("none"),
    )


def json_broken(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no JSON are skipped."""
    events = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("props"))
    return reads.find_json(events, "props", {"k": {"$gt": 50}})


def dedup_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest_by_key(table(spark, d, "events"), ["user_id"], ["event_id"])


def named_like(spark: SparkSession, d: str) -> DataFrame:
    return catalog.named_like(table(spark, d, "part").select("p_partkey", "p_name"), "RIN", "p_name")


def last_samples(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_samples(table(spark, d, "events").select("event_id", "value"), "event_id")


def level_totals(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select((F.col("p_size") % 3).cast("int").alias("level"), F.col("p_partkey").alias("bytes"))
    return catalog.total_bytes(catalog.level_metrics(files))


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    each = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).when(F.col("event_id") % 3 == 1, F.lit("null")).otherwise(F.col("props"))
    return catalog.record_count(events.select("event_id", each.alias("answer")), "answer").select("event_id", "records")


SESSION = [
    'insertOne c {"_id":"1","x":1}', 'insertMany c [{"_id":"2","x":2},{"_id":"3","x":3},{"x":4}]', 'FINDONE c {"_id": "2"}', 'findMany c {"x":{"$gt":1}}', 'updateOne c {"_id":"1"} {"$set":{"x":9}}',
    'updateOne c {"_id":"nobody"} {"$set":{"x":9}}', 'findOne c {"_id":"1"}', 'deleteOne c {"_id":"3"}', "dumpAll c", "compact", "nonsense",
]
ANSWERS = [
    "inserted 1", "inserted 2 of 3", '{\n  "_id": "2",\n  "x": 2\n}', '{\n  "_id": "2",\n  "x": 2\n}\n{\n  "_id": "3",\n  "x": 3\n}\n2 documents', "updated", "not found",
    '{\n  "_id": "1",\n  "x": 9\n}', "deleted", '{\n  "_id": "1",\n  "x": 9\n}\n{\n  "_id": "2",\n  "x": 2\n}', "nothing to compact", "unknown command: nonsense",
]


def shell_session(spark: SparkSession, d: str) -> DataFrame:
    shell = Shell(Store(spark, scratch(spark)))
    ended = shell.run("exit") is None and shell.run("quit") is None
    return spark.createDataFrame([(k, shell.run(line)) for k, line in enumerate(SESSION)] + [(len(SESSION), f"ended {ended}")], "step long, answer string")


CALLS = [
    ("GET", "/api/health", None, 200, '{"status": "ok"}'),
    ("POST", "/api/c", '{"_id":"1","x":1}', 201, '{"status": "created", "key": "c:1"}'),
    ("POST", "/api/c", '{"x":1}', 400, None),
    ("POST", "/api/c/_insertMany", '[{"_id":"2","x":2},{"_id":"3","x":3}]', 200, '{"status": "ok", "insertedCount": 2}'),
    ("POST", "/api/c/_insertMany", "[]", 200, '{"status": "ok", "insertedCount": 0}'),
    ("POST", "/api/c/_search", '{"x":{"$gt":2}}', 200, '[{"_id": "3", "x": 3}]'),
    ("PUT", "/api/c/4", '{"y":1}', 200, '{"status": "ok", "key": "c:4"}'),
    ("GET", "/api/c/4", None, 200, '{"y":1}'),
    ("DELETE", "/api/c/4", None, 200, '{"status": "deleted", "key": "c:4"}'),
    ("GET", "/api/c/4", None, 404, '{"error": "Key not found", "status": 404}'),
    ("GET", "/api/_collections", None, 200, '[{"name": "c", "docCount": 3, "byteSize": 0}]'),
    ("GET", "/api/_compact", None, 202, '{"status": "compaction started"}'),
    ("PATCH", "/api/c/4", None, 405, None),
    ("GET", "/elsewhere", None, 404, None),
]


def rest_session(spark: SparkSession, d: str) -> DataFrame:
    server = serve(Store(spark, scratch(spark)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method: str, path: str, body: str | None) -> tuple[int, str]:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=None if body is None else body.encode())
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    found = [(k, *call(*c[:3])) for k, c in enumerate(CALLS)]
    server.shutdown()
    return spark.createDataFrame([(k, status, body if CALLS[k][4] else None) for k, status, body in found], "step long, status int, body string")


def queries() -> dict[str, Query]:
    return {
        "store_snapshot": store_snapshot, "store_compacted": store_compacted, "store_full_compaction": store_full_compaction, "store_find": store_find, "store_get": store_get,
        "store_recovered": store_recovered, "buffer_scan": buffer_scan, "store_restore": store_restore, "store_dump_counts": store_dump_counts, "store_collections": store_collections,
        "store_metrics": store_metrics, "store_generated": store_generated, "legacy_migrated": legacy_migrated, "key_helpers": key_helpers, "json_broken": json_broken,
        "dedup_by_rank": dedup_by_rank, "named_like": named_like, "last_samples": last_samples, "level_totals": level_totals, "record_counts": record_counts,
        "shell_session": shell_session, "rest_session": rest_session,
    }


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0"


def oracle_sql() -> dict[str, str]:
    live = "(SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0)"
    puts = "(SELECT count(*) + count(*) FILTER (s_suppkey % 3 = 0) + count(*) FILTER (s_suppkey % 7 = 0) + 1 FROM supplier)"
    return {
        "store_snapshot": _SUPPLIER,
        "store_compacted": _SUPPLIER,
        "store_full_compaction": _SUPPLIER,
        "store_find": f"SELECT * FROM (SELECT * FROM ({_SUPPLIER}) WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 5, 7) ORDER BY CAST(s_suppkey AS VARCHAR) LIMIT 1000)",
        "store_get": "SELECT id, s_name FROM (VALUES ('1'), ('3'), ('7'), ('nobody'), ('new')) v(id) LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'new', 'N') USING (id)",
        "store_recovered": "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 'last', arg_max(n_name, n_nationkey) FROM nation",
        "buffer_scan": """SELECT collection, _id, n_name, tombstone, row_number() OVER (ORDER BY collection, _id) - 1 AS ord FROM (
          SELECT 'r' || n_regionkey AS collection, CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_regionkey = 0 AND n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS n_name,
            n_regionkey = 0 AND n_nationkey % 5 = 0 AS tombstone FROM nation
          UNION ALL SELECT 'r0', CAST(k AS VARCHAR), NULL, true FROM range(0, 25, 5) r(k) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))""",
        "store_restore": """SELECT CAST(r_regionkey AS VARCHAR) AS _id, CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region WHERE r_regionkey > 2
          UNION ALL SELECT CAST(k - 6 AS VARCHAR), CAST(k AS VARCHAR), 'R' || k FROM range(6, 9) t(k)""",
        "store_dump_counts": "SELECT 'supplier' AS name, CAST(count(*) AS INTEGER) AS n, max(CAST(s_suppkey AS VARCHAR)) AS last_id FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'extra', 2, '2'",
        "store_collections": f"SELECT name, CAST(n AS BIGINT) AS docCount, CAST(0 AS BIGINT) AS byteSize FROM (VALUES ('a', 1), ('b', 2), ('supplier', {live})) v(name, n)",
        "store_metrics": f"""SELECT name, CAST(v AS BIGINT) AS value FROM (VALUES ('puts', {puts}), ('gets', 1), ('deletes', 1), ('flushes', 3), ('compacts', 0), ('memtable_entries', 2),
          ('memtable_bytes', {len('supplier:x') + len('supplier:y') + len('{"_id": "x"}')}), ('immutable_count', 0), ('level_0_files', 3), ('level_1_files', 0), ('level_2_files', 0)) t(name, v)""",
        "store_generated": "SELECT collection, true AS some, true AS sized FROM (VALUES " + ", ".join(f"('{c}')" for c in COLLECTIONS) + ") v(collection)",
        "legacy_migrated": "SELECT 'nation' AS collection, CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_nationkey < 10 THEN replace(n_name, 'NATION', 'LATE') ELSE n_name END AS n_name FROM nation",
        "key_helpers": """SELECT p_partkey, p_brand || ':k:' || p_partkey AS key, p_brand AS collection, 'k:' || p_partkey AS id, 'L' || (p_partkey % 3) || '_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS file,
          CAST(p_partkey % 3 AS INTEGER) AS level, p_partkey AS number, least(p_size / 40.0 * 100, 100.0)::DOUBLE AS percent, CAST(NULL AS VARCHAR) AS none FROM part""",
        "json_broken": "SELECT event_id, props FROM events WHERE event_id % 3 <> 0 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50",
        "dedup_by_rank": "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
        "named_like": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'rin')",
        "last_samples": "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 30",
        "level_totals": "SELECT CAST(coalesce(sum(p_partkey), 0) AS BIGINT) AS total_bytes FROM part",
        "record_counts": "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS records FROM events",
        "shell_session": "SELECT CAST(step AS BIGINT) AS step, answer FROM (VALUES " + ", ".join(f"({k}, {_quoted(a)})" for k, a in enumerate([*ANSWERS, "ended True"])) + ") v(step, answer)",
        "rest_session": "SELECT CAST(step AS BIGINT) AS step, CAST(status AS INTEGER) AS status, body FROM (VALUES " + ", ".join(f"({k}, {c[3]}, {_quoted(c[4])})" for k, c in enumerate(CALLS)) + ") v(step, status, body)",
    }

