import json
import os
import random
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera.http_api import serve
from tessera.operators import catalog
from tessera.shell import Shell
from tessera.sources import legacy
from tessera.sources.generate import COLLECTIONS, FIELDS, load_random, random_documents
from tessera.sources.store import Busy, Rejected, Store
from tessera.streaming.fold import fold, latest_state, read_changes


def state(store):
    return {(r.collection, r._id): json.loads(r.doc) for r in store.snapshot().collect()}


def test_random_operations_and_compaction(spark, tmp_path):
    rng, store, model = random.Random(1), Store(spark, str(tmp_path / "db"), flush_entries=3), {}
    for step in range(14):
        batch = store.batch()
        for _ in range(rng.randint(1, 6)):
            key = (rng.choice("ab"), rng.choice(["1", "10", "2", "é", ""]))
            if rng.random() < 0.3:
                batch.delete(*key)
                model.pop(key, None)
            else:
                doc = {"n": rng.random(), "_id": key[1]}
                batch.put(*key, json.dumps(doc))
                model[key] = doc
        assert store.apply(batch) == len(batch)
        if step in (4, 11):
            assert state(store) == model
            assert all((found := store.get(*key)) is None if key not in model else json.loads(store.get(*key)) == model[key] for key in [("a", "1"), ("b", "2")])
    assert 2 <= store.metrics()["flushes"] and state(store) == model
    store.flush()
    assert store.compact(force=True) and state(store) == model and store.metrics()["level_2_files"] == 1
    assert store.vacuum() > 0 and state(store) == model
    for (c, i), doc in model.items():
        assert json.loads(store.get(c, i)) == doc
    assert store.get("a", "absent") is None
    assert {r.name: r.docCount for r in store.collections().collect()} == {c: sum(k[0] == c for k in model) for c in {k[0] for k in model}}
    assert [tuple(r) for r in store.keys().collect()] == sorted(model)
    store.dump(str(tmp_path / "lines"))
    store.dump_object(str(tmp_path / "object"))
    for name in ("lines", "object"):
        other = Store(spark, str(tmp_path / f"db-{name}"))
        assert other.restore(str(tmp_path / name)) == len(model) and state(other) == model
        assert other.metrics()["puts"] == len(model)
    with pytest.raises(Rejected):
        store.insert_many("a", [{"_id": "x"}, {"_id": 5}])
    assert store.insert_many("a", [{"_id": "x"}, {"_id": 5}, 3], strict=False) == (1, 3)
    with pytest.raises(Rejected):
        store.put("a:b", "1", "{}")
    with pytest.raises(Rejected):
        store.put("a", "1", "null")


def test_many_puts_leave_few_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), flush_entries=10)
    for i in range(100):
        store.put("c", f"{i:03d}", {"_id": f"{i:03d}", "n": i})
    found = store.metrics()
    assert sum(found[f"level_{n}_files"] for n in range(3)) < 5 and found["flushes"] == 10 and found["compacts"] >= 2 and found["memtable_entries"] == 0
    assert len(state(store)) == 100
    store.put("c", "100", {"_id": "100"})
    found = store.metrics()
    assert (found["memtable_entries"], found["memtable_bytes"], found["immutable_count"]) == (1, len("c:100") + len('{"_id": "100"}'), 0)
    assert store.buffer.scan() == [("c", "100", '{"_id": "100"}', False)] and store.get("c", "100") == '{"_id": "100"}'


def test_level_one_goes_into_level_two(spark, tmp_path):
    store, model = Store(spark, str(tmp_path / "db"), flush_entries=2, l1_bytes=1), {}
    rng = random.Random(3)
    for step in range(26):
        key = rng.choice("abcdefgh")
        if rng.random() < 0.2:
            store.delete("c", key)
            model.pop(("c", key), None)
        else:
            store.put("c", key, {"_id": key, "step": step})
            model["c", key] = {"_id": key, "step": step}
    found = store.metrics()
    assert found["level_1_files"] == 0 and found["level_2_files"] >= 1 and found["compacts"] >= 4 and state(store) == model


def test_recovery_replays_what_no_run_holds(spark, tmp_path):
    root = str(tmp_path / "db")
    store = Store(spark, root, flush_entries=4)
    for i in range(6):
        store.put("c", str(i), {"_id": str(i)})
    store.delete("c", "0")
    want, runs = state(store), len(store.manifest()["runs"])
    again = Store(spark, root, flush_entries=4)  # the first one never ended well
    assert state(again) == want and len(again.buffer) == 3 and len(again.manifest()["runs"]) == runs
    small = Store(spark, root, flush_entries=1)  # more than a buffer holds is flushed while it is replayed
    assert state(small) == want and len(small.buffer) <= 1 and len(small.manifest()["runs"]) > runs
    small.put("c", "0", {"_id": "0", "new": True})
    small.close()
    assert state(Store(spark, root)) == want | {("c", "0"): {"_id": "0", "new": True}} and not Store(spark, root).buffer


def test_busy_when_too_many_flushes_wait(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), flush_entries=1)
    store._drain = lambda: None  # a worker that doesn't come round
    for i in range(4):
        store.put("c", str(i), {"_id": str(i)})
    assert store.metrics()["immutable_count"] == 3 and len(state(store)) == 4
    with pytest.raises(Busy):
        store.put("c", "4", {"_id": "4"})
    assert store.get("c", "4") is None and store.get("c", "0") == '{"_id": "0"}'
    del store._drain
    store.put("c", "4", {"_id": "4"}) if store.flush() is None else None
    assert len(state(store)) == 5


def test_background_worker(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), flush_entries=5, background=True)
    for i in range(23):
        while True:
            try:
                store.put("c", str(i), {"_id": str(i)})
                break
            except Busy:
                time.sleep(0.05)
    store.close()
    assert len(state(store)) == 23 and store.metrics()["memtable_entries"] == 0 and store.metrics()["flushes"] >= 4


def test_restore_keeps_the_later_of_repeated_ids(spark, tmp_path):
    for trial in range(4):
        docs = [{"_id": str(k % 5), "at": k, "x": "abc"[(k * 7 + trial) % 3] * k} for k in range(20)]
        (tmp_path / f"o{trial}.json").write_text(json.dumps({"c": docs, "d": docs[:1]}))
        (tmp_path / f"l{trial}.json").write_text("".join(json.dumps({"collection": "c", "_id": d["_id"], "doc": d}) + "\n" for d in docs) + "\n")
        for form in "ol":
            store = Store(spark, str(tmp_path / f"db-{form}{trial}"))
            assert store.restore(str(tmp_path / f"{form}{trial}.json")) == 20 + (form == "o")
            assert {k: v["at"] for (c, k), v in state(store).items() if c == "c"} == {str(k): 15 + k for k in range(5)}
    (tmp_path / "bad.json").write_text('{"c": [{"_id": "1"}, {"_id": 2}]}')
    with pytest.raises(Rejected):
        Store(spark, str(tmp_path / "db-bad")).restore(str(tmp_path / "bad.json"))


def test_shell(spark, tmp_path):
    shell = Shell(Store(spark, str(tmp_path / "db")))
    assert shell.run('INSERTMANY products [{"_id":"p1","name":"Laptop","price":1200},{"_id":"p2","name":"Mouse"},{"name":"x"}]') == "inserted 2 of 3"
    assert json.loads(shell.run('findOne products {"_id": "p1"}'))["price"] == 1200
    assert shell.run('findMany products {"price":{"$gt": 1000}}').endswith("1 documents")
    assert shell.run('updateOne products {"_id": "p1"} {"$set": {"name": "Laptop Pro"}}') == "updated"
    assert shell.run('updateOne products {"_id": "p1"} {"$inc": {"price": 1}}') == "updated"
    assert json.loads(shell.run('findOne products {"_id":"p1"}')) == {"_id": "p1", "name": "Laptop Pro", "price": 1200}
    assert shell.run('deleteOne products {"_id":"nobody"}') == "deleted" and shell.run('findOne products {"_id":"nobody"}') == "not found"
    assert shell.run("compact") in ("compacted", "nothing to compact") and shell.run("exit") is None and "unknown" in shell.run("what")
    assert shell.run("findOne products 5").startswith("error") and shell.completions("find") == ["findOne", "findMany"] and shell.completions("findOne pro") == ["products"]


def test_http(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    server = serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=None if body is None else body.encode())
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read() or "null")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("GET", "/api/health") == (200, {"status": "ok"})
    assert call("POST", "/api/c", '{"_id":"1","x":1}') == (201, {"status": "created", "key": "c:1"})
    assert call("POST", "/api/c", '{"x":1}')[0] == 400 and call("POST", "/api/c", "[")[1]["status"] == 400
    assert call("POST", "/api/c/_insertMany", '[{"_id":"2","x":2},{"_id":"3"}]') == (200, {"status": "ok", "insertedCount": 2})
    assert call("POST", "/api/c/_insertMany", "[]") == (200, {"status": "ok", "insertedCount": 0}) and call("POST", "/api/c/_insertMany", '[{"_id":"9"},{}]')[0] == 400
    assert call("POST", "/api/c/_search", '{"x":{"$gt":1}}') == (200, [{"_id": "2", "x": 2}])
    assert call("PUT", "/api/c/4", '{"y":1}') == (200, {"status": "ok", "key": "c:4"}) and call("GET", "/api/c/4") == (200, {"y": 1})
    assert call("DELETE", "/api/c/4") == (200, {"status": "deleted", "key": "c:4"}) and call("GET", "/api/c/4") == (404, {"error": "Key not found", "status": 404})
    assert call("GET", "/api/_collections") == (200, [{"name": "c", "docCount": 3, "byteSize": 0}])
    assert call("PATCH", "/api/c/4")[0] == 405 and call("GET", "/nothing")[0] == 404 and call("GET", "/api/metrics")[1]["puts"] == 4
    assert call("GET", "/api/metrics")[1]["memtable_entries"] == 4 and call("GET", "/api/_compact") == (202, {"status": "compaction started"})
    stats = call("GET", "/api/stats")[1]
    assert {"process_cpu_percent", "process_rss_mb", "process_rss_limit_mb", "go_num_goroutine", "go_alloc_mb", "go_num_gc", "system_cpu_percent"} <= stats.keys() and stats["process_rss_mb"] > 10
    store.put = lambda *_: (_ for _ in ()).throw(Busy("too many"))
    assert call("POST", "/api/c", '{"_id":"1","x":1}') == (503, {"error": "Database is busy, please retry", "status": 503})
    server.shutdown()


def test_legacy(spark, tmp_path):
    one, two = f"{tmp_path}/old/1.db", f"{tmp_path}/old/2.db"
    (tmp_path / "old").mkdir()
    legacy.write_entries(two, [(b"a:1", b'{"v":9}'), (b"a:3", b'{"v":5}')])
    legacy.write_entries(one, [(b"a:1", b'{"v":1}'), (b"bad", b"{}"), (b"a:1", b'{"v":2}'), (b"a:x:y", b'{"v":3}'), (b"a:3", b'{"v":4}')])
    store = Store(spark, str(tmp_path / "db"))
    legacy.migrate(store, f"{tmp_path}/old")
    assert state(store) == {("a", "1"): {"v": 9}, ("a", "x:y"): {"v": 3}, ("a", "3"): {"v": 5}}
    key, value, end = legacy.read_entry_at(spark, one, 0)
    assert (key, value, end) == (b"a:1", b'{"v":1}', 18) and legacy.read_entry_at(spark, one, end) == (b"bad", b"{}", 31)
    assert legacy.read_entry_at(spark, one, 3) is None and legacy.read_entry_at(spark, one, 10**6) is None


def test_generator(spark, tmp_path):
    docs = random_documents(spark, 300, 3)
    rows = docs.collect()
    assert rows == random_documents(spark, 300, 3).collect() and docs.columns == ["collection", "_id", *FIELDS] and len(FIELDS) == 25
    assert {r.collection for r in rows} == set(COLLECTIONS) and len({r._id for r in rows}) == 300
    assert all(8 <= sum(r[f] is not None for f in FIELDS) <= 16 for r in rows)
    assert all(10 <= r.price <= 5000 for r in rows if r.price is not None) and all(1 <= len(set(r.tags)) == len(r.tags) <= 3 for r in rows if r.tags)
    store = Store(spark, str(tmp_path / "db"))
    load_random(store, 300, 3)
    want = [r for r in rows if r.collection == "users" and r.category in ("books", "toys")]
    assert store.find("users", {"category": {"$in": ["books", "toys"]}}, None).count() == len(want) and sum(r.docCount for r in store.collections().collect()) == 300
    store.insert_frame("gen", docs.drop("collection"))
    assert store.snapshot("gen").count() == 300


def test_damaged_pages_are_noticed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.insert_frame("c", spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("_id"), "id"))
    part = sorted((tmp_path / "db").glob("data/*/*/*/part-*.parquet"))[0]
    data = bytearray(part.read_bytes())
    for i in range(1000, 1100):
        data[i] ^= 0x55
    part.write_bytes(bytes(data))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)checksum|crc|corrupt"):
        store.snapshot().collect()


def test_metrics_are_polled(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "db")), []
    for sample in store.samples(0.01):
        seen.append(sample)
        store.put("c", str(len(seen)), {})
        if len(seen) == 3:
            store.close()
    assert [s["puts"] for s in seen] == [0, 1, 2] and seen[0]["time"] < seen[2]["time"]


def test_stream_state_stays_small(spark, tmp_path):
    rows = spark.range(2600).select(F.pmod("id", F.lit(7)).alias("k"), "id", (F.col("id") % 5 == 0).alias("gone"))
    rows.repartitionByRange(26, "id").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        fold(read_changes(spark, f"{tmp_path}/in", rows.schema, 1), ["k"], ["id"], f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    names = sorted(n for n in os.listdir(f"{tmp_path}/state") if "=" in n)
    assert len(names) <= 7 and sum(n.startswith("base") for n in names) == 1
    got = {r.k: r.id for r in latest_state(spark, f"{tmp_path}/state", ["k"], ["id"]).collect()}
    assert got == {k: max(i for i in range(2600) if i % 7 == k) for k in range(7)}


def test_catalog_helpers(spark):
    names = spark.createDataFrame([("Orders",), ("users",), ("borders",)], "name string")
    assert sorted(r.name for r in catalog.named_like(names, "ORDER").collect()) == ["Orders", "borders"]
    assert [r.id for r in catalog.last_samples(spark.range(100), "id", 3).collect()] == [97, 98, 99]
    assert catalog.total_bytes(spark.createDataFrame([(0, 2, 10), (1, 1, 5)], "level int, files long, bytes long")).first()[0] == 15
    answers = spark.createDataFrame([("[1,2,{}]",), ("{}",), ("null",), (None,), ("[]",)], "r string")
    assert [r.records for r in catalog.record_count(answers, "r").collect()] == [3, 1, 0, 0, 0]
