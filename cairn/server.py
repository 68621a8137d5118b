"""HTTP interface to the collections under a root folder: JSON over the standard library's threaded server, on the driver.

Requests only plan; the work is Spark's. Errors come as {"error": code, "message": text} with the error's status.
"""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from cairn import model
from cairn.sources.collection import CollectionManager

#: Bytes of a request's body that are accepted.
LARGEST = 64 << 20
_SUMMARY = ("name", "dimension", "metric", "index_type", "num_vectors", "num_deleted")


class Service:
    """The routes: (method, pattern) -> function(body, *names) -> (status, value)."""

    def __init__(self, spark: SparkSession, root: str):
        self.manager, self.lock = CollectionManager(spark, root), threading.Lock()
        self.manager.load_all()
        c, one = r"/collections/([^/]+)", r"/vectors/([^/]+)"
        self.routes = [
            ("GET", "/health", self.health), ("GET", "/metrics", lambda b: (200, self.manager.metrics())),
            ("GET", "/collections", lambda b: (200, {"collections": self.manager.list()})), ("POST", "/collections", self.create),
            ("GET", c, lambda b, n: (200, self.manager.get(n).stats())), ("DELETE", c, self.drop),
            ("POST", f"{c}/vectors", self.insert), ("GET", c + one, lambda b, n, i: (200, self.manager.get(n).get(i))), ("DELETE", c + one, self.delete),
            ("POST", f"{c}/search", self.search), ("POST", f"{c}/search/text", self.text), ("POST", f"{c}/search/hybrid", self.hybrid),
            ("POST", f"{c}/optimize", lambda b, n: (200, self.manager.get(n).optimize())), ("POST", f"{c}/snapshot", lambda b, n: (201, {"path": self.manager.get(n).snapshot()})),
            ("POST", f"{c}/checkpoint", self.checkpoint),
        ]

    def answer(self, method: str, path: str, body: dict | None) -> tuple[int, object]:
        known = False
        for m, pattern, work in self.routes:
            if found := re.fullmatch(pattern, path):
                known = True
                if m == method:
                    try:
                        return work(body or {}, *map(unquote, found.groups()))
                    except model.EngineError as e:
                        return e.status, {"error": e.code, "message": str(e)}
                    except (KeyError, TypeError, ValueError) as e:
                        return 400, {"error": "invalid_request", "message": f"{type(e).__name__}: {e}"}
        return (405, {"error": "method_not_allowed", "message": method}) if known else (404, {"error": "not_found", "message": path})

    def health(self, body: dict):
        return 200, {"status": "degraded" if self.manager.failed else "ok", "collections": len(self.manager.open), "failed": self.manager.failed}

    def create(self, body: dict):
        options = {k: body[k] for k in ("metric", "index_type", "text_field", "index_params") if body.get(k) is not None}
        with self.lock:
            s = self.manager.create(body["name"], body["dimension"], **options).stats()
        return 201, {k: s[k] for k in _SUMMARY}

    def drop(self, body: dict, name: str):
        self.manager.drop(name)
        return 200, {"dropped": name}

    def insert(self, body: dict, name: str):
        return 201, self.manager.get(name).insert(body["items"], upsert=bool(body.get("upsert", False)))

    def delete(self, body: dict, name: str, id: str):
        self.manager.get(name).delete(id)
        return 200, {"deleted": id}

    def checkpoint(self, body: dict, name: str):
        self.manager.get(name).checkpoint()
        return 200, {"checkpointed": name}

    def search(self, body: dict, name: str):
        return 200, {"results": self.manager.get(name).search(body["vector"], body.get("k", 10), body.get("filter"), body.get("params"))}

    def text(self, body: dict, name: str):
        return 200, {"results": self.manager.get(name).search_text(body["text"], body.get("k", 10), body.get("filter"))}

    def hybrid(self, body: dict, name: str):
        return 200, {"results": self.manager.get(name).search_hybrid(body["vector"], body["text"], body.get("k", 10), body.get("filter"), body.get("params"))}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST:
                self.close_connection = True
                status, value = 413, {"error": "batch_too_large", "message": f"{size} bytes"}
            else:
                raw = self.rfile.read(size) if size else b""
                try:
                    body = json.loads(raw) if raw else None
                    if body is not None and not isinstance(body, dict):
                        raise ValueError("the body isn't an object")
                    status, value = service.answer(self.command, self.path.partition("?")[0], body)
                except ValueError as e:
                    status, value = 400, {"error": "invalid_request", "message": str(e)}
            text = value if isinstance(value, str) else json.dumps(value)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound but not running yet: call ``serve_forever``, here or in a thread. Port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), handler(Service(spark, root)))
