"""A document store: an append-only Parquet changelog under a versioned manifest, behind a write buffer.

Writes go to a log, a small file for each batch, and to a buffer on the driver; a buffer that is full by entries or
bytes is frozen and flushed as one run (``data/level=L/run=N/collection=C``), sorted by id, after which the next manifest is
published and the log is cut.  With ``background`` a worker flushes and compacts; at most ``FROZEN`` buffers wait for it,
and beyond that writes are refused (``Busy``).  A store that is opened again replays what its manifest doesn't name.
Readers take a manifest and the buffers once, so they keep a snapshot; files that no manifest names are ignored.
Recency is (commit, place in the batch), assigned on the driver and kept by compaction, so levels may overlap freely.
Tombstones go only in a compaction that includes every older run.  After each flush compactions run until none is due.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import LEVELS
from ..operators.catalog import collections as count_collections
from ..operators.merge import latest_by_key
from ..operators.reads import CAP, capped, matches_json
from .buffer import Batch, Buffer, Entry, Log
from .files import Files

ROW = T.StructType(
    [T.StructField("_id", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("tombstone", T.BooleanType()),
     T.StructField("commit", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("level", T.IntegerType()),
     T.StructField("run", T.StringType()), T.StructField("collection", T.StringType())]
)
BATCH = 1000
L0_FILES, L1_BYTES = 4, 100 << 20
#: A buffer is flushed from so many entries or bytes on; so many frozen ones may wait.
FLUSH_ENTRIES, FLUSH_BYTES, FROZEN = 10_000, 16 << 20, 3


class Rejected(ValueError):
    """A request that is refused as a whole."""


class Busy(RuntimeError):
    """Too many flushes are pending; the write may be tried again."""


def parse_object(text: str | bytes) -> dict[str, Any]:
    """A JSON object; the last of repeated keys counts; numbers out of range are refused."""

    def refuse(x: str) -> Any:
        raise Rejected(f"not a JSON number: {x}")

    try:
        found = json.loads(text, parse_constant=refuse, parse_float=lambda x: v if abs(v := float(x)) != float("inf") else refuse(x))
    except json.JSONDecodeError as e:
        raise Rejected(f"invalid JSON: {e}") from e
    if not isinstance(found, dict):
        raise Rejected("a document must be a JSON object")
    return found


def check_collection(name: str) -> str:
    if not name or ":" in name:
        raise Rejected("a collection needs a name without ':'")
    return name


def document_id(doc: dict[str, Any]) -> str:
    if not isinstance(doc, dict) or not isinstance(doc.get("_id"), str):
        raise Rejected("a document needs a string _id")
    return doc["_id"]


class Store:
    def __init__(self, spark: SparkSession, root: str, flush_entries: int = FLUSH_ENTRIES, flush_bytes: int = FLUSH_BYTES, l1_bytes: int = L1_BYTES, background: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.flush_entries, self.flush_bytes, self.l1_bytes = flush_entries, flush_bytes, l1_bytes
        self.files = Files(spark, self.root)
        self.files.make("manifest")
        self.counters = dict.fromkeys(("puts", "gets", "deletes", "flushes", "compacts"), 0)
        self.buffer, self.frozen = Buffer(), []
        self._lock, self._one_flush = threading.RLock(), threading.RLock()
        self.log = Log(self.files)
        self.log.last = max(self.log.last, self.manifest()["logged"])
        self._recover()
        self._wake, self._worker, self._closed = threading.Event(), None, False
        if background:
            self._worker = threading.Thread(target=self._work, daemon=True)
            self._worker.start()

    # manifest
    def manifest(self) -> dict[str, Any]:
        """The newest one, or an empty one."""
        names = [n for n in self.files.names("manifest") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"version": 0, "commit": 0, "logged": 0, "runs": []}
        return {"logged": 0} | json.loads(self.files.read(f"manifest/{names[-1]}"))

    def _publish(self, old: dict[str, Any], commit: int, logged: int, runs: list[dict[str, Any]]) -> None:
        new = {"version": old["version"] + 1, "commit": commit, "logged": logged, "runs": runs}
        if not self.files.create(f"manifest/{new['version']:012d}.json", json.dumps(new).encode()):
            raise RuntimeError("another writer has committed meanwhile")

    # buffer
    def _recover(self) -> None:
        """What the log holds beyond the manifest; flushed where it is too much for one buffer."""
        for number, entry in self.log.replay(self.manifest()["logged"]):
            if self.buffer.logged not in (0, number) and self._full():
                self.flush()
            self.buffer.write(entry)
            self.buffer.logged = number

    def _full(self) -> bool:
        return len(self.buffer) >= self.flush_entries or self.buffer.bytes >= self.flush_bytes

    def _rotate(self) -> None:
        if len(self.frozen) >= FROZEN:
            raise Busy("too many pending flushes, please retry")
        self.frozen.append(self.buffer)
        self.buffer = Buffer()

    def _drain(self) -> None:
        """Flushes frozen buffers, oldest first, and compacts what is due."""
        with self._one_flush:
            while self.frozen:
                own = self.frozen[0]
                old = self.manifest()
                number = old["commit"] + 1
                run = self._write(own.frame(self.spark).withColumn("commit", F.lit(number).cast("long")), 0, number)
                with self._lock:
                    self._publish(old, number, own.logged, [*old["runs"], run])
                    self.frozen.pop(0)
                self.log.drop(own.logged)
                self.counters["flushes"] += 1
            while self.compact():
                pass

    def flush(self) -> None:
        """Everything that is buffered becomes a run, and compactions that are due are done, before this returns."""
        with self._one_flush:
            self._drain()
            with self._lock:
                if len(self.buffer):
                    self._rotate()
            self._drain()

    def _work(self) -> None:
        while not self._closed:
            self._wake.wait()
            self._wake.clear()
            self._drain()

    def close(self) -> None:
        """Flushes and ends the worker."""
        self._closed = True
        self._wake.set()
        if self._worker:
            self._worker.join()
        self.flush()

    def _write(self, rows: DataFrame, level: int, number: int) -> dict[str, Any]:
        run = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/data/level={level}/run={run}"
        rows.select("_id", "doc", "tombstone", "commit", "ord", "collection").sortWithinPartitions("collection", "_id").write.partitionBy("collection").option(
            "parquet.bloom.filter.enabled#_id", "true"
        ).parquet(path)
        own = self._read([path])
        s = own.agg(F.min("_id"), F.max("_id"), F.count("*")).first()
        size = self.files.size(path.removeprefix(f"{self.root}/"))
        return {"level": level, "path": path, "run": number, "min_key": s[0], "max_key": s[1], "key_count": s[2], "bytes": size}

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ROW)
        # pages carry checksums, which a read compares
        return self.spark.read.schema(ROW).option("basePath", f"{self.root}/data").option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    # writes
    def commit(self, rows: DataFrame) -> int:
        """(collection, _id, doc, tombstone, ord) as one run of level 0, newer than all that is buffered."""
        with self._one_flush:
            self.flush()
            old = self.manifest()
            number = old["commit"] + 1
            run = self._write(rows.withColumn("commit", F.lit(number).cast("long")), 0, number)
            with self._lock:
                self._publish(old, number, old["logged"], [*old["runs"], run])
            self.counters["flushes"] += 1
            self.counters["puts"] += run["key_count"]
            self._drain()
        return number

    def apply(self, entries: Iterable[Entry]) -> int:
        """A batch of (collection, id, document or None, tombstone); later entries win.

        It is logged as a whole before it is buffered.  Refused as a whole if the buffer is full and too many wait.
        """
        rows = list(entries)
        if not rows:
            return 0
        with self._lock:
            if self._full():
                self._rotate()
            self.buffer.logged = self.log.append(rows)
            for row in rows:
                self.buffer.write(row)
            gone = sum(r[3] for r in rows)
            self.counters["deletes"] += gone
            self.counters["puts"] += len(rows) - gone
            full = self._full()
            if full and len(self.frozen) < FROZEN:
                self._rotate()
        if full:
            if self._worker:
                self._wake.set()
            else:
                self._drain()
        return len(rows)

    @staticmethod
    def batch() -> Batch:
        """To be filled and given to ``apply``."""
        return Batch()

    def put(self, collection: str, id_: str, doc: str | dict[str, Any]) -> None:
        text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)
        parse_object(text)
        self.apply([(check_collection(collection), id_, text, False)])

    update = put

    def delete(self, collection: str, id_: str) -> None:
        self.apply([(check_collection(collection), id_, None, True)])

    def insert_one(self, collection: str, doc: str) -> str:
        id_ = document_id(parse_object(doc))
        self.put(collection, id_, doc)
        return id_

    def insert_many(self, collection: str, docs: list[Any], strict: bool = True) -> tuple[int, int]:
        """(inserted, given).  Strict: the first bad document refuses all, and a batch has a cap; else bad ones are skipped."""
        check_collection(collection)
        if strict and len(docs) > BATCH:
            raise Rejected(f"at most {BATCH} documents at once")
        good = []
        for d in docs:
            try:
                if not isinstance(d, dict):
                    raise Rejected("a document must be a JSON object")
                good.append((collection, document_id(d), json.dumps(d, ensure_ascii=False, sort_keys=True), False))
            except Rejected:
                if strict:
                    raise
        return self.apply(good), len(docs)

    def insert_frame(self, collection: str, df: DataFrame) -> int:
        """Documents of a DataFrame with ``_id``; on the executors, in one commit."""
        doc = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
        rows = df.where(F.col("_id").isNotNull()).select(
            F.lit(check_collection(collection)).alias("collection"), F.col("_id").cast("string"), doc.alias("doc"), F.lit(False).alias("tombstone"), F.monotonically_increasing_id().alias("ord")
        )
        return self.commit(rows)

    def update_one(self, collection: str, id_: str, update: dict[str, Any]) -> bool:
        """``$set`` of top-level keys; other operators change nothing; False if there is no such document."""
        found = self.get(collection, id_)
        if found is None:
            return False
        doc = parse_object(found)
        if isinstance(update.get("$set"), dict):
            doc |= update["$set"]
        self.put(collection, id_, doc)
        return True

    # reads
    def _buffers(self) -> tuple[list[dict[str, Any]], list[tuple[int, Buffer]]]:
        """The runs, and the buffers by their commits to be, at one time."""
        with self._lock:
            now = self.manifest()
            return now["runs"], list(enumerate([*self.frozen, self.buffer], now["commit"] + 1))

    def versions(self) -> DataFrame:
        runs, buffers = self._buffers()
        rows = self._read([r["path"] for r in runs])
        for commit, own in buffers:
            if len(own):
                rows = rows.unionByName(own.frame(self.spark).withColumn("commit", F.lit(commit).cast("long")), allowMissingColumns=True)
        return rows

    def snapshot(self, collection: str | None = None) -> DataFrame:
        """(collection, _id, doc) of live documents; a collection prunes partitions before the merge."""
        rows = self.versions().select("collection", "_id", "doc", "tombstone", "commit", "ord")
        if collection is not None:
            rows = rows.where(F.col("collection") == collection)
        return latest_by_key(rows, ["collection", "_id"], ["commit", "ord"], F.col("tombstone")).select("collection", "_id", "doc")

    def get(self, collection: str, id_: str) -> str | None:
        """The buffers first, newest first; then the runs whose id range holds the id, by their bloom filters."""
        self.counters["gets"] += 1
        runs, buffers = self._buffers()
        for _, own in reversed(buffers):
            if (found := own.get(collection, id_)) is not None:
                return None if found[1] else found[0]
        paths = [r["path"] for r in runs if r["min_key"] is not None and r["min_key"] <= id_ <= r["max_key"]]
        rows = self._read(paths).where((F.col("collection") == collection) & (F.col("_id") == id_))
        found = rows.orderBy(F.desc("commit"), F.desc("ord")).limit(1).select("doc", "tombstone").collect()
        return found[0].doc if found and not found[0].tombstone else None

    def find(self, collection: str, filter_: dict[str, Any] | None = None, limit: int | None = CAP, extended: bool = False) -> DataFrame:
        found = self.snapshot(collection).where(matches_json("doc", filter_, extended)).select("_id", "doc")
        return capped(found, limit) if limit else found.orderBy("_id")

    def keys(self, limit: int = 0) -> DataFrame:
        found = self.snapshot().select("collection", "_id").orderBy("collection", "_id")
        return found.limit(limit) if limit else found

    def collections(self) -> DataFrame:
        return count_collections(self.snapshot()).orderBy("name")

    def metrics(self) -> dict[str, int]:
        out = self.counters | {"memtable_entries": len(self.buffer), "memtable_bytes": self.buffer.bytes, "immutable_count": len(self.frozen)}
        runs = self.manifest()["runs"]
        for level in range(LEVELS):
            own = [r for r in runs if r["level"] == level]
            out |= {f"level_{level}_files": len(own), f"level_{level}_bytes": sum(r["bytes"] for r in own)}
        return out

    def samples(self, every: float = 2.0) -> Iterator[dict[str, float]]:
        """The metrics again and again, each with its time, for charts."""
        while not self._closed:
            yield {"time": time.time(), **self.metrics()}
            time.sleep(every)

    # maintenance
    def due(self, old: dict[str, Any]) -> tuple[list[dict[str, Any]], int] | None:
        """(runs, level to write) of the compaction that is due: level 0 into 1 from four runs on, else beyond the limit the
        first run of level 1 with what it overlaps into 2."""
        level = [[r for r in old["runs"] if r["level"] == n] for n in range(LEVELS)]
        if len(level[0]) >= L0_FILES:
            return level[0], 1
        if sum(r["bytes"] for r in level[1]) > self.l1_bytes:
            first = min(level[1], key=lambda r: (r["min_key"] or "", r["run"]))
            # what is older than it and overlaps it below, so that recency by level isn't needed
            return [first, *(r for r in level[2] if r["max_key"] >= first["min_key"] and r["min_key"] <= first["max_key"])], 2
        return None

    def compact(self, force: bool = False) -> bool:
        """One compaction that is due; with ``force`` all runs into the last level."""
        with self._one_flush:
            old = self.manifest()
            chosen, to = (old["runs"], LEVELS - 1) if force and len(old["runs"]) > 1 else self.due(old) or ([], 0)
            if not chosen:
                return False
            rest = [r for r in old["runs"] if r not in chosen]
            rows = self._read([r["path"] for r in chosen]).select("collection", "_id", "doc", "tombstone", "commit", "ord")
            rows = latest_by_key(rows, ["collection", "_id"], ["commit", "ord"])
            run = self._write(rows if rest else rows.where(~F.col("tombstone")), to, old["commit"])
            with self._lock:
                self._publish(old, old["commit"], old["logged"], [*rest, run] if run["key_count"] else rest)
            self.counters["compacts"] += 1
            return True

    def vacuum(self) -> int:
        """Deletes runs that no manifest of this store names; snapshots taken earlier must be done."""
        named, gone = {r["path"].rpartition("/")[2] for r in self.manifest()["runs"]}, 0
        for level in self.files.names("data"):
            for run in self.files.names(f"data/{level}"):
                if run not in named:
                    self.files.delete(f"data/{level}/{run}")
                    gone += 1
        return gone

    # whole databases
    def dump(self, path: str) -> None:
        """A text dataset with a line for each document: {"collection", "_id", "doc"}; no collection has to fit in a task."""
        dump_lines(self.snapshot().where(F.try_parse_json("doc").isNotNull())).write.mode("overwrite").text(path)

    def dump_object(self, path: str) -> None:
        """One JSON object {collection: [documents]} in one file, for small databases: all goes through one task."""
        live = self.snapshot().where(F.try_parse_json("doc").isNotNull())
        own = F.map_concat(F.map_filter(F.from_json("doc", "map<string,variant>"), lambda k, _: k != "_id"), F.create_map(F.lit("_id"), F.col("_id").cast("variant")))
        docs = live.select("collection", "_id", own.alias("d")).groupBy("collection").agg(F.sort_array(F.collect_list(F.struct("_id", F.to_json("d").alias("d")))).alias("docs"))
        line = F.concat(_quoted("collection"), F.lit(":["), F.array_join(F.col("docs.d"), ","), F.lit("]"))
        docs.select(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(line)), ","), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)

    def dump_name(self) -> str:
        return time.strftime("dump_%H%M%S_%d%m%Y.json")

    def restore(self, path: str) -> int:
        """Upserts all documents of a dump, or none if one has no string ``_id``; of repeated ids the later one wins."""
        rows = restore_rows(self.spark, path)
        bad, n = rows.agg(F.count_if(F.col("_id").isNull()), F.count("*")).first()
        if bad:
            raise Rejected(f"{bad} documents have no string _id")
        if n:
            newest = latest_by_key(rows, ["collection", "_id"], ORDER)
            self.commit(newest.drop(*ORDER).withColumns({"tombstone": F.lit(False), "ord": F.lit(0).cast("long")}))
        return n


#: Where a document stands in a dump: file, part of the file, line, place in the line.
ORDER = ["file", "part", "line", "at"]


def _quoted(column: str) -> Column:
    """A string column as JSON text."""
    wrapped = F.to_json(F.struct(F.col(column).alias("c")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def dump_lines(live: DataFrame) -> DataFrame:
    """(collection, _id, doc) -> a JSON object for each document."""
    doc = F.to_json(F.try_parse_json("doc"))
    return live.select(F.concat(F.lit('{"collection":'), _quoted("collection"), F.lit(',"_id":'), _quoted("_id"), F.lit(',"doc":'), doc, F.lit("}")).alias("value"))


def restore_rows(spark: SparkSession, path: str) -> DataFrame:
    """(collection, _id, doc) and ``ORDER`` of the documents of a dump: lines of this store, or a whole file ``{collection:
    [documents]}``.  The first line tells which; only a dump of one object is read a file at a time."""
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    own = get("$._id", "string").isNotNull() & get("$.collection", "string").isNotNull()
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.try_parse_json("value").alias("v")).select(F.coalesce(own, F.lit(False)).alias("own")).collect()
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")]
    if first and first[0].own:
        rows = spark.read.text(path).select("value", *place).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"), *ORDER[:3])
        id_ = F.when(own, get("$._id", "string"))
        return rows.select(get("$.collection", "string").alias("collection"), id_.alias("_id"), F.to_json(get("$.doc", "variant")).alias("doc"), *ORDER[:3], F.lit(0).alias("at"))
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), *place).where(F.col("v").isNotNull())
    each = whole.select(F.explode(F.try_variant_get("v", "$", "map<string,array<variant>>")).alias("collection", "docs"), *ORDER[:3])
    each = each.select("collection", *ORDER[:3], F.posexplode("docs").alias("at", "d"))
    kind = F.schema_of_variant(F.try_variant_get("d", "$._id", "variant"))
    return each.select("collection", F.when(kind == "STRING", F.try_variant_get("d", "$._id", "string")).alias("_id"), F.to_json("d").alias("doc"), *ORDER[:3], F.col("at").cast("int").alias("at"))
