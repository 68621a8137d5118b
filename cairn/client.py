"""Client of the HTTP interface, with the standard library only."""

from __future__ import annotations

import json
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from cairn import model

_ERRORS = {e.code: e for e in vars(model).values() if isinstance(e, type) and issubclass(e, model.EngineError)}


class Client:
    """Methods mirror the routes; an error of the server is raised as the engine's error of that code."""

    def __init__(self, url: str, timeout: float = 600):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: dict | None = None):
        data = None if body is None else json.dumps({k: v for k, v in body.items() if v is not None}).encode()
        request = Request(self.url + path, data, {"Content-Type": "application/json"}, method=method)
        try:
            with urlopen(request, timeout=self.timeout) as r:
                text = r.read().decode()
                return json.loads(text) if r.headers.get_content_type() == "application/json" else text
        except HTTPError as e:
            found = json.loads(e.read() or b"{}")
            raise _ERRORS.get(found.get("error"), model.EngineError)(found.get("message", str(e))) from None

    @staticmethod
    def _of(name: str, *more: str) -> str:
        return "/".join(["/collections", *(quote(x, safe="") for x in (name,)), *more])

    def health(self) -> dict:
        return self._call("GET", "/health")

    def metrics(self) -> str:
        return self._call("GET", "/metrics")

    def collections(self) -> list[dict]:
        return self._call("GET", "/collections")["collections"]

    def create(self, name: str, dimension: int, **options) -> dict:
        return self._call("POST", "/collections", {"name": name, "dimension": dimension, **options})

    def describe(self, name: str) -> dict:
        return self._call("GET", self._of(name))

    def drop(self, name: str) -> dict:
        return self._call("DELETE", self._of(name))

    def insert(self, name: str, items: list[dict], upsert: bool = False) -> dict:
        """Insert in batches of the server's size."""
        n = 0
        for i in range(0, max(len(items), 1), 1000):
            n += self._call("POST", self._of(name, "vectors"), {"items": items[i : i + 1000], "upsert": upsert})["inserted"]
        return {"inserted": n}

    def get(self, name: str, id: str) -> dict:
        return self._call("GET", self._of(name, "vectors", quote(id, safe="")))

    def delete(self, name: str, id: str) -> dict:
        return self._call("DELETE", self._of(name, "vectors", quote(id, safe="")))

    def search(self, name: str, vector: list[float], k: int = 10, filter: dict | None = None, params: dict | None = None) -> list[dict]:
        return self._call("POST", self._of(name, "search"), {"vector": vector, "k": k, "filter": filter, "params": params})["results"]

    def search_text(self, name: str, text: str, k: int = 10, filter: dict | None = None) -> list[dict]:
        return self._call("POST", self._of(name, "search", "text"), {"text": text, "k": k, "filter": filter})["results"]

    def search_hybrid(self, name: str, vector: list[float], text: str, k: int = 10, filter: dict | None = None, params: dict | None = None) -> list[dict]:
        return self._call("POST", self._of(name, "search", "hybrid"), {"vector": vector, "text": text, "k": k, "filter": filter, "params": params})["results"]

    def optimize(self, name: str) -> dict:
        return self._call("POST", self._of(name, "optimize"))

    def snapshot(self, name: str) -> str:
        return self._call("POST", self._of(name, "snapshot"))["path"]

    def checkpoint(self, name: str) -> dict:
        return self._call("POST", self._of(name, "checkpoint"))
