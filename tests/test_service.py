"""The command line, the HTTP interface with its client, and timing."""

from __future__ import annotations

import json
import threading

import pytest

from cairn import cli, model, timing
from cairn.client import Client
from cairn.server import serve

ROWS = [{"id": f"r{i}", "vector": [float(i == j) + 0.01 * i for j in range(4)], "metadata": {"kind": "ab"[i % 2], "words": f"row number {i}"}} for i in range(4)]


def test_command_line(spark, tmp_path, capsys):
    root, file = f"file://{tmp_path}/root", tmp_path / "rows.jsonl"
    file.write_text("\n".join(json.dumps(r) for r in ROWS))

    def call(*args, fails=False):
        assert cli.main([root, "--json", *args]) == int(fails)
        out = capsys.readouterr()
        return out.err if fails else [json.loads(x) for x in out.out.splitlines() if x]

    assert call("create", "c", "4", "--metric", "l2", "--text-field", "words")[0]["dimension"] == 4
    assert call("insert", "c", str(file))[0]["inserted"] == 4
    assert "id_exists" in call("insert", "c", str(file), fails=True)
    assert call("insert", "c", str(file), "--upsert")[0]["inserted"] == 4
    assert call("ls")[0]["num_vectors"] == 4 and call("describe", "c")[0]["num_deleted"] == 4
    assert call("get", "c", "r1")[0]["metadata"]["kind"] == "b"
    assert call("query", "c", "1,0,0,0", "-k", "1")[0]["id"] == "r0"
    assert [h["id"] for h in call("query", "c", "[0,1,0,0]", "--filter", '{"kind": "a"}')] == ["r0", "r2"]
    assert call("search-text", "c", "number 3")[0]["id"] == "r3"
    assert call("hybrid", "c", "0,0,0,1", "3")[0]["id"] == "r3"
    call("delete", "c", "r2")
    assert "id_not_found" in call("get", "c", "r2", fails=True)
    assert call("optimize", "c")[0]["num_vectors"] == 3 and call("health")[0]["collections"] == 1
    call("rm", "c")
    assert "collection_not_found" in call("describe", "c", fails=True)
    assert cli.table([{"a": 1, "b": "xx"}, {"a": 22}]) == "a   b\n1   xx\n22"


def test_http_and_client(spark, tmp_path):
    server = serve(spark, f"file://{tmp_path}/http", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = Client(f"http://127.0.0.1:{server.server_address[1]}")
        assert c.health() == {"status": "ok", "collections": 0, "failed": {}}
        assert c.create("odd name ü", 4, metric="l2", text_field="words")["num_vectors"] == 0
        with pytest.raises(model.CollectionExists):
            c.create("odd name ü", 4)
        assert c.insert("odd name ü", ROWS)["inserted"] == 4
        assert c.get("odd name ü", "r1")["metadata"] == ROWS[1]["metadata"]
        assert c.search("odd name ü", ROWS[2]["vector"], 1)[0] == {"id": "r2", "internal_id": 2, "score": 0.0, "metadata": ROWS[2]["metadata"]}
        assert c.search_text("odd name ü", "3", 1)[0]["id"] == "r3"
        assert c.search_hybrid("odd name ü", ROWS[3]["vector"], "3", 1)[0]["ranks"] == {"dense": 1, "sparse": 1}
        c.delete("odd name ü", "r0")
        for call, error in ((lambda: c.get("odd name ü", "r0"), model.IdNotFound), (lambda: c.describe("none"), model.CollectionNotFound), (lambda: c.search("odd name ü", [1.0], 1), model.DimensionMismatch), (lambda: c._call("POST", "/collections", {}), model.InvalidRequest)):
            with pytest.raises(error):
                call()
        with pytest.raises(model.EngineError):
            c._call("GET", "/nowhere")
        c.checkpoint("odd name ü")
        assert c.optimize("odd name ü")["num_vectors"] == 3 and c.snapshot("odd name ü")
        assert 'cairn_vectors{collection="odd name ü"} 3' in c.metrics()
        assert c.describe("odd name ü")["latency"]["search"]["n"] == 1
        c.drop("odd name ü")
        assert c.collections() == []
    finally:
        server.shutdown()


def test_timing(tmp_path):
    assert [timing.percentile([4, 1, 3, 2], p) for p in (0, 25, 50, 75, 99, 100)] == [1, 1, 2, 3, 4, 4]
    calls = []
    s = timing.measure(lambda: calls.append(1), 5, warm=2)
    assert len(calls) == 7 and s["n"] == 5 and s["p50"] <= s["p99"] and timing.summary([]) == {"n": 0}
    path = str(tmp_path / "r.csv")
    timing.write(path, [{"a": 1, "b": 2}, {"a": 3, "c": 4}])
    assert open(path).read().split() == ["a,b,c", "1,2,", "3,,4"]
    assert json.load(open(tmp_path / "r.env.json"))["cpus"]
