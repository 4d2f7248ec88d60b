"""A thin HTTP face of a store on the standard library, and an asyncio one."""

from __future__ import annotations

import asyncio
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, unquote, urlparse

from ..functions.metrics import Metrics, prometheus
from ..operators.txn import ConflictError, WriteBatch
from ..schema import DEFAULT_CF
from .store import CommitConflict, Store, UnknownColumnFamily


def serve(store: Store, port: int = 0, metrics: Metrics | None = None) -> ThreadingHTTPServer:
    """A server that isn't started yet: call serve_forever on it. Every route takes ?cf=."""
    metrics, lock = metrics or Metrics(), Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def reply(self, body, status: int = 200, kind: str = "application/json"):
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_one(self, method: str):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            cf = q.get("cf", DEFAULT_CF)
            what, _, arg = url.path.strip("/").partition("/")
            arg = unquote(arg)
            pairs = lambda df: [{"key": r.key, "value": r.value} for r in df.toLocalIterator()]
            try:
                if what == "key" and method == "GET":
                    with metrics.timer("read"):
                        value = store.get(arg, cf)
                    return self.reply({"key": arg, "value": value}) if value is not None else self.reply({"error": "not found"}, 404)
                if what == "key" and method in ("PUT", "DELETE"):
                    body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8", "replace")
                    with lock, metrics.timer("write", len(body)):
                        store.put(arg, body, cf) if method == "PUT" else store.delete(arg, cf)
                    return self.reply({"ok": True})
                if method == "GET" and what == "scan":
                    return self.reply(pairs(store.scan(q.get("from", ""), q.get("to", ""), cf)))
                if method == "GET" and what == "prefix":
                    return self.reply(pairs(store.scan_prefix(arg, cf)))
                if method == "GET" and what == "snapshot":
                    snap = store.snapshot(cf)
                    return self.reply({"seq": snap.seq, "entries": pairs(snap.rows())})
                if method == "GET" and what == "stats":
                    return self.reply([r.asDict() for r in store.stats().collect()])
                if method == "GET" and what == "metrics":
                    return self.reply(prometheus(metrics.frame(store.spark)), kind="text/plain")
                return self.reply({"error": "no such route"}, 404)
            except UnknownColumnFamily as e:
                return self.reply({"error": f"unknown column family {e}"}, 500)
            except (CommitConflict, ConflictError) as e:  # another writer was faster: the client may try again
                return self.reply({"error": f"conflict: {e}"}, 409)

        def do_GET(self):
            self.handle_one("GET")

        def do_PUT(self):
            self.handle_one("PUT")

        def do_DELETE(self):
            self.handle_one("DELETE")

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


class AsyncStore:
    """The store's calls off the event loop; writes one at a time."""

    def __init__(self, store: Store):
        self.inner, self._lock = store, asyncio.Lock()

    async def get(self, key, cf: str = DEFAULT_CF):
        return await asyncio.to_thread(self.inner.get, key, cf)

    async def scan(self, lo, hi, cf: str = DEFAULT_CF):
        return await asyncio.to_thread(lambda: self.inner.scan(lo, hi, cf).collect())

    async def scan_prefix(self, prefix, cf: str = DEFAULT_CF):
        return await asyncio.to_thread(lambda: self.inner.scan_prefix(prefix, cf).collect())

    async def snapshot(self, cf: str = DEFAULT_CF):
        return await asyncio.to_thread(self.inner.snapshot, cf)

    async def _write(self, f, *a):
        async with self._lock:
            return await asyncio.to_thread(f, *a)

    async def put(self, key, value, cf: str = DEFAULT_CF):
        return await self._write(self.inner.put, key, value, cf)

    async def put_with_ttl(self, key, value, ttl_ms: int, now: int, cf: str = DEFAULT_CF):
        return await self._write(self.inner.put_with_ttl, key, value, ttl_ms, now, cf)

    async def delete(self, key, cf: str = DEFAULT_CF):
        return await self._write(self.inner.delete, key, cf)

    async def delete_range(self, lo, hi, cf: str = DEFAULT_CF):
        return await self._write(self.inner.delete_range, lo, hi, cf)

    async def write_batch(self, batch: WriteBatch):
        return await self._write(self.inner.write_batch, batch)
