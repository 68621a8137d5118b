"""The ways that large tables take, on small ones: bounds are lowered so that they are taken."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.vector import scores
from cairn.model import Metric
from cairn.operators import bm25, hnsw, ivf, knn


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.fixture
def small_cells(monkeypatch):
    """Every search is cut into many cells; none may be paired as packed blocks."""

    def refused(*_):
        raise AssertionError("blocks are paired")

    for name, value in {"LIGHT_WORK": 0, "CELL_NUMBERS": 500, "CELL_WORK": 20_000, "LEAST_WORK": 1, "SCREEN": 16, "PAIRS_WORK": 20_000, "block_top_k": refused}.items():
        monkeypatch.setattr(knn, name, value)


def brute(x, k, metric):
    s = np.round(scores(metric, x, x), 6)
    ids = np.arange(len(x))
    return {(q, int(i), rank + 1) for q, o in enumerate(s if metric.ascending else -s) for rank, i in enumerate(np.lexsort((ids, o))[:k])}


def got(df):
    return {(r.qid, r.id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("metric", list(Metric))
def test_cells_are_exact(spark, small_cells, metric):
    x = np.random.default_rng(3).standard_normal((150, 8))
    x[7], x[9:15] = 0, x[8]  # copies are ties
    v = frame(spark, x)
    assert got(knn.knn(v, v, 10, metric)) == brute(x, 10, metric)
    dead = v.where("id % 3 = 0").select("id")
    assert all(r.id % 3 for r in knn.knn(v, v, 10, metric, exclude=dead).collect())


def test_no_cell_has_a_whole_list(spark, small_cells, monkeypatch):
    """One list that everybody probes is spread over tasks, and no task holds more of it than a cell may."""
    x = np.random.default_rng(5).standard_normal((400, 8))
    v = frame(spark, x).withColumn("by", F.lit(0).cast("long"))
    make = lambda ids, vectors, queries: iter([__import__("pyarrow").RecordBatch.from_pydict({"n": [len(ids)], "m": [sum(len(i) for i, _ in queries)]})])
    rows = knn.cells(v, v, {0: (400, 400)}, 8, make, "n long, m long", 200_000).collect()
    assert len(rows) >= 7 and max(r.n for r in rows) <= 100 and sum(r.n * r.m for r in rows) == 400 * 400


def test_pairs_in_cells(spark, small_cells):
    x = np.random.default_rng(6).standard_normal((60, 4)) * 10
    x[5] = x[4]
    v = frame(spark, x)
    rows = {(r.qid, r.id): r.score for r in knn.pairwise(v, v.where("id < 50"), "l2").collect()}
    assert len(rows) == 60 * 50
    assert all(abs(s - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-6 for (q, i), s in rows.items()) and rows[5, 4] == rows[3, 3] == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_screen_keeps_what_double_precision_finds(metric):
    rng = np.random.default_rng(7)
    near = rng.standard_normal((300, 6)) + 1000  # far from the origin, near each other
    for x in (rng.standard_normal((500, 24)), near, rng.integers(0, 2, (400, 5)).astype(float), np.zeros((200, 3)), rng.standard_normal((200, 4)) * 1e18, rng.standard_normal((3, 4))):
        ids = rng.permutation(len(x)).astype(np.int64)
        held = knn.Held(ids, x, metric)
        r, i, s = held.nearest(x[:40], 10)
        w = held.exact(x[:40], np.linalg.norm(x[:40], axis=1), np.repeat(np.arange(min(40, len(x))), len(x)), np.tile(np.arange(len(x)), min(40, len(x)))).reshape(-1, len(x))
        for q in range(min(40, len(x))):
            order = np.lexsort((ids, w[q] if metric.ascending else -w[q]))[:10]
            assert i[r == q].tolist() == ids[order].tolist() and s[r == q].tolist() == w[q][order].tolist()


def test_probing_in_cells(spark, small_cells, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.standard_normal((50, 8)) for c in rng.standard_normal((4, 8)) * 3])
    v = frame(spark, x)
    c = spark.createDataFrame([(i, x[i * 50].tolist()) for i in range(4)], "cid long, vector array<double>")
    path = f"file://{tmp_path}/lists"
    ivf.write_lists(v.where("id % 5 != 0"), c, "l2", path)
    lists, pending = ivf.read_lists(spark, [path]), v.where("id % 5 = 0")
    to = {r.id: r.cid for r in ivf.assign(v, c).collect()}
    d = ((x[:, None] - x[::50][None]) ** 2).sum(2)
    s = np.round(scores(Metric.L2, x, x), 6)
    for nprobe in (2, 4):
        want = set()
        for q in range(len(x)):
            probed = set(np.argsort(np.round(d[q], 9), kind="stable")[:nprobe].tolist())
            may = np.array([i for i in range(len(x)) if i % 5 == 0 or to[i] in probed])
            want |= {(q, int(i), rank + 1) for rank, i in enumerate(may[np.lexsort((may, s[q][may]))[:10]])}
        assert got(ivf.search(lists, c, v, 10, nprobe, "l2", pending=pending)) == want
    dead = v.where("id % 2 = 0").select("id")
    assert all(r.id % 2 for r in ivf.search(lists, c, v, 5, 2, "l2", exclude=dead).collect())


def test_many_queries_scan_shards(spark):
    """From SCAN_QUERIES queries on a search of graphs is exact, however narrow its beam; fewer queries walk."""
    x = np.random.default_rng(8).standard_normal((300, 32))
    v = frame(spark, x)
    index = hnsw.build(v, "cosine", 4, 8, shards=2).persist()
    assert got(hnsw.search(index, v, 10, "cosine", 10)) == brute(x, 10, Metric.COSINE)
    walked = got(hnsw.search(index, v.where("id < 20"), 10, "cosine", 10))
    assert len(walked) == 200 and walked != {r for r in brute(x, 10, Metric.COSINE) if r[0] < 20}


@pytest.mark.parametrize("metric", list(Metric))
def test_exact_construction_is_a_walk_with_a_perfect_beam(metric, monkeypatch):
    """With a beam as wide as the shard, both ways of construction give the same graph."""
    x = np.random.default_rng(9).standard_normal((120, 6))
    one = hnsw.Graph(metric, 4, 120).build(x)
    one.validate()
    monkeypatch.setattr(hnsw, "EXACT_ROWS", 0)
    other = hnsw.Graph(metric, 4, 120).build(x)
    assert one.histogram() == other.histogram() and one.entry == other.entry
    if metric is not Metric.DOT:  # by dot product not all nodes are reached
        assert sorted(one.edges()) == sorted(other.edges())


def words(spark, n):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 200)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "!!!"), (n + 1, ""), (n + 2, None)], "id long, text string")


@pytest.fixture
def written(spark, monkeypatch):
    """Plans of the tables that are written."""
    plans, kind = [], type(spark.range(1).write)
    write = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    return plans


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch, written):
    """Stored postings of many tasks a folder are those of the plan; counting and ordering them takes one exchange."""
    monkeypatch.setattr(bm25, "TASK_CHARS", 200)
    docs, path = words(spark, 300), f"file://{tmp_path}/index"
    bm25.write_index(docs, path)
    assert [p.count("Exchange ") for p in written] == [1, 0]
    found = bm25.read_postings(spark, path)
    d = bm25.indexed(docs)
    rows = lambda df: sorted(map(tuple, df.select("term", "id", "tf", "dl").collect()))
    assert rows(found) == rows(bm25.postings(d)) and found.where("bucket < 0").count() == 0
    assert sorted(map(tuple, bm25.read_lengths(spark, path).collect())) == sorted(map(tuple, bm25.lengths(d).collect()))
    assert found.where(F.col("bucket") == bm25.bucket(F.col("term"), bm25.BUCKETS)).count() == found.count()
    assert max(r["count"] for r in found.groupBy("bucket", F.input_file_name()).count().collect()) < found.groupBy("bucket").count().agg(F.max("count")).first()[0]


def test_batches_of_text_by_documents(spark, monkeypatch):
    """Scoring in document parts gives what the equi-join gives."""
    d = bm25.indexed(words(spark, 300))
    found, s = bm25.postings(d), bm25.stats(d)
    q = spark.createDataFrame([("a", "w1 w2 w2 nothing"), ("b", "w3"), ("c", "nothing"), ("d", "w1 w150 w7 w9")], "qid string, text string")
    rows = lambda: sorted(map(tuple, bm25.search_batch(found, s, q, 20).collect()))
    monkeypatch.setattr(bm25, "BATCH_POSTINGS", 100)
    parts = rows()
    monkeypatch.setattr(bm25, "BATCH_TERMS", 0)
    assert parts == rows() and {r[0] for r in parts} == {"a", "b", "d"}


def test_insert_keeps_the_order_without_a_sort(spark, tmp_path, written):
    """Rows are numbered in the frame's order as they are written; nothing is sorted for that, nor for a log of one batch."""
    from cairn.session import with_ordinals
    from cairn.sources.collection import Collection

    df = spark.createDataFrame([(str(100 - i), [float(i), 1.0]) for i in range(40)], "id string, vector array<float>").repartition(5).sortWithinPartitions("id")
    assert [r.id for r in with_ordinals(df, [], "pos").orderBy("pos").collect()] == [r.id for r in df.collect()]
    assert "Exchange rangepartitioning" not in written[0]
    c = Collection.create(spark, f"file://{tmp_path}/c", 2, metric="l2")
    c.insert(df)
    assert "Window" not in c.live()._jdf.queryExecution().executedPlan().toString()
    c.insert(df.where("id = '99'"), upsert=True)
    assert c.live().count() == 40 and c.live().where("id = '99'").first().internal_id == 40
