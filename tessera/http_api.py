"""The REST door: a thin gateway over the store."""

from __future__ import annotations

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from .sources.store import Busy, Rejected, Store, parse_object

BODY, CONCURRENT = 10 << 20, 100


class Answer(Exception):
    """An error: its status and what it says."""

    def __init__(self, status: int, message: str):
        self.status, self.message = status, message


def process_stats(store: Store, before: tuple[float, float]) -> dict[str, Any]:
    """Figures of the driver's processes under the fixed names of the interface; ``before``: wall and CPU seconds at the start."""
    with open("/proc/self/statm") as f:
        resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    heap = store.spark.sparkContext._jvm.java.lang.management.ManagementFactory
    used = heap.getMemoryMXBean().getHeapMemoryUsage()
    wall, cpu = time.time() - before[0], time.process_time() - before[1]
    return {
        "process_cpu_percent": round(100 * cpu / max(wall, 1e-9), 3), "process_rss_mb": resident, "process_rss_limit_mb": memory_limit_mb(),
        "go_num_goroutine": threading.active_count(), "go_alloc_mb": used.getUsed() >> 20, "go_sys_mb": used.getMax() >> 20, "go_heap_alloc_mb": used.getUsed() >> 20,
        "go_heap_inuse_mb": used.getCommitted() >> 20, "go_num_gc": sum(b.getCollectionCount() for b in heap.getGarbageCollectorMXBeans()),
        "system_cpu_percent": round(100 * os.getloadavg()[0] / (os.cpu_count() or 1), 3),
    }


def memory_limit_mb() -> float:
    """Of the container, or of the machine."""
    for name in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(name) as f:
                if (text := f.read().strip()).isdigit() and int(text) < 1 << 60:
                    return int(text) / 2**20
        except OSError:
            continue
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**20


def serve(store: Store, host: str = "127.0.0.1", port: int = 6866) -> ThreadingHTTPServer:
    """A server that isn't started: call ``serve_forever``."""
    room, writing, began = threading.Semaphore(CONCURRENT), threading.Lock(), (time.time(), time.process_time())

    class Handler(BaseHTTPRequestHandler):
        timeout = 30

        def log_message(self, *_: Any) -> None:
            pass

        def answer(self, status: int, body: Any, raw: bool = False) -> None:
            data = body.encode() if raw else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def fail(self, status: int, message: str) -> None:
            self.answer(status, {"error": message, "status": status})

        def body(self) -> str:
            n = int(self.headers.get("Content-Length") or 0)
            if n > BODY:
                raise Answer(413, "the body is too large")
            return self.rfile.read(n).decode()

        def handle_any(self) -> None:
            if not room.acquire(timeout=30):
                return self.fail(503, "Too many requests, please retry")
            try:
                self.route()
            except Answer as a:
                self.fail(a.status, a.message)
            except Busy:
                self.fail(503, "Database is busy, please retry")
            except (Rejected, UnicodeDecodeError, json.JSONDecodeError) as e:
                self.fail(400, str(e))
            except Exception as e:  # noqa: BLE001  a request must not end the server
                self.fail(500, str(e)[:500])
            finally:
                room.release()

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = handle_any  # noqa: N815

        def route(self) -> None:
            parts = [unquote(p) for p in urlsplit(self.path).path.strip("/").split("/")]
            method = self.command
            if len(parts) == 1 and parts[0].endswith(".ico"):
                return self.answer(200, "", raw=True)
            if parts[0] != "api" or len(parts) not in (2, 3):
                raise Answer(404, "not found")
            fixed = {"health": self.health, "stats": self.stats, "metrics": self.metrics, "_collections": self.listing, "_compact": self.compact}
            if len(parts) == 2 and parts[1] in fixed:
                return fixed[parts[1]]()
            if len(parts) == 2:
                if method != "POST":
                    raise Answer(404, "not found")
                text = self.body()
                with writing:
                    id_ = store.insert_one(parts[1], text)
                return self.answer(201, {"status": "created", "key": f"{parts[1]}:{id_}"})
            name, last = parts[1:]
            if method == "POST" and last == "_insertMany":
                docs = json.loads(self.body())
                if not isinstance(docs, list):
                    raise Rejected("an array is needed")
                with writing:
                    n = store.insert_many(name, docs)[0]
                return self.answer(200, {"status": "ok", "insertedCount": n})
            if method == "POST" and last == "_search":
                filter_ = json.loads(self.body() or "{}")
                if filter_ is not None and not isinstance(filter_, dict):
                    raise Rejected("a filter must be an object")
                return self.answer(200, "[" + ",".join(r.doc for r in store.find(name, filter_).collect()) + "]", raw=True)
            if method == "GET":
                found = store.get(name, last)
                return self.fail(404, "Key not found") if found is None else self.answer(200, found, raw=True)
            if method == "PUT":
                text = self.body()
                parse_object(text)
                with writing:
                    store.put(name, last, text)
                return self.answer(200, {"status": "ok", "key": f"{name}:{last}"})
            if method == "DELETE":
                with writing:
                    store.delete(name, last)
                return self.answer(200, {"status": "deleted", "key": f"{name}:{last}"})
            raise Answer(405, "method not allowed")

        def health(self) -> None:
            self.answer(200, {"status": "ok"})

        def metrics(self) -> None:
            self.answer(200, store.metrics())

        def stats(self) -> None:
            self.answer(200, process_stats(store, began))

        def listing(self) -> None:
            self.answer(200, [r.asDict() for r in store.collections().collect()])

        def compact(self) -> None:
            def work() -> None:
                with writing:
                    store.compact()

            threading.Thread(target=work, daemon=True).start()
            self.answer(202, {"status": "compaction started"})

    return ThreadingHTTPServer((host, port), Handler)
