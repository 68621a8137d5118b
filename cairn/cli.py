"""Command line: collections under a root folder. ``python -m cairn.cli ROOT COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import sys

from cairn import model
from cairn.sources import readers
from cairn.sources.collection import CollectionManager


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("root")
    p.add_argument("--json", action="store_true", help="print JSON lines")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create")
    c.add_argument("name")
    c.add_argument("dimension", type=int)
    c.add_argument("--metric", default="cosine")
    c.add_argument("--index", default="flat")
    c.add_argument("--text-field")
    p_serve = sub.add_parser("serve")
    p_serve.add_argument("--host", default="127.0.0.1")
    p_serve.add_argument("--port", type=int, default=8080)
    for name in ("ls", "metrics", "health"):
        sub.add_parser(name)
    for name in ("describe", "rm", "optimize", "snapshot", "checkpoint"):
        sub.add_parser(name).add_argument("name")
    i = sub.add_parser("insert")
    i.add_argument("name")
    i.add_argument("file", help="JSON lines or a JSON array; - is the standard input")
    i.add_argument("--upsert", action="store_true")
    for name in ("get", "delete"):
        g = sub.add_parser(name)
        g.add_argument("name")
        g.add_argument("id")
    for name in ("query", "hybrid", "search-text"):
        q = sub.add_parser(name)
        q.add_argument("name")
        if name != "search-text":
            q.add_argument("vector", help="numbers with commas, JSON, or @file")
        if name != "query":
            q.add_argument("text")
        q.add_argument("-k", type=int, default=10)
        q.add_argument("--filter", type=json.loads)
        q.add_argument("--params", type=json.loads)
    return p


def run(m: CollectionManager, a: argparse.Namespace):
    vector = lambda: readers.parse_vector(open(a.vector[1:]).read() if a.vector.startswith("@") else a.vector)
    c = lambda: m.get(a.name)
    return {
        "create": lambda: m.create(a.name, a.dimension, metric=a.metric, index_type=a.index, text_field=a.text_field).m,
        "ls": m.list, "metrics": lambda: (m.load_all(), m.metrics())[1], "health": lambda: {"status": "ok", "collections": len(m.load_all()), "failed": m.failed},
        "describe": lambda: c().stats(), "rm": lambda: m.drop(a.name), "optimize": lambda: c().optimize(), "snapshot": lambda: c().snapshot(), "checkpoint": lambda: c().checkpoint(),
        "insert": lambda: c().insert(readers.read_items(m.spark, a.file), upsert=a.upsert), "get": lambda: c().get(a.id), "delete": lambda: c().delete(a.id),
        "query": lambda: c().search(vector(), a.k, a.filter, a.params), "search-text": lambda: c().search_text(a.text, a.k, a.filter), "hybrid": lambda: c().search_hybrid(vector(), a.text, a.k, a.filter, a.params),
    }[a.command]()


def table(rows: list[dict]) -> str:
    """Columns under their names, as wide as their widest value."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *([str(r.get(k, "")) for k in names] for r in rows)]
    wide = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, wide)).rstrip() for c in cells)


def show(value, as_json: bool) -> None:
    if isinstance(value, list) and value and not as_json and all(isinstance(v, dict) for v in value):
        print(table(value))
        return
    for v in value if isinstance(value, list) else [] if value is None else [value]:
        print(json.dumps(v) if as_json or not isinstance(v, dict) and not isinstance(v, str) else v if isinstance(v, str) else "  ".join(f"{k}={x}" for k, x in v.items()))


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    try:
        if a.command == "serve":
            from cairn.server import serve

            serve(spark, a.root, a.host, a.port).serve_forever()
        show(run(CollectionManager(spark, a.root), a), a.json)
        return 0
    except model.EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
