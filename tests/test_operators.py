from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import model
from cairn.functions import vector as V
from cairn.functions.text import query_tokens, tokens
from cairn.model import IndexType, Metric, fetch_size
from cairn.operators import bm25, evaluate, fusion, hnsw, ivf, knn
from cairn.sources import readers


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vector array<double>")


def test_hand_knn(spark):
    c, q = frame(spark, [(1, 0), (0, 1), (0.8, 0.6), (-1, 0)]), frame(spark, [(1, 0)])
    rows = knn.knn(c, q, 4, "l2").orderBy("rank").collect()
    assert [r.id for r in rows] == [0, 2, 1, 3]
    assert np.allclose([r.score**2 for r in rows], [0, 0.4, 2, 4], atol=1e-5)
    with pytest.raises(model.InvalidRequest):
        knn.knn(c, q, 0)


@pytest.mark.parametrize("metric", list(Metric))
def test_expressions_equal_kernel(spark, metric):
    x = np.random.default_rng(1).standard_normal((30, 8))
    x[3] = 0
    a = frame(spark, x)
    b = a.select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    want = {(r.qid, r.id): r.s for r in a.crossJoin(b).select("qid", "id", V.score(metric, F.col("vector"), F.col("q")).alias("s")).collect()}
    for r in knn.pairwise(a, a, metric).collect():
        assert math.isclose(r.score, want[r.qid, r.id], abs_tol=2e-6)
    d = V.distance(metric, F.col("vector"), F.col("q"))
    for r in a.crossJoin(b).select(V.score_of(metric, d).alias("s"), V.score(metric, F.col("vector"), F.col("q")).alias("t"), V.distance_of(metric, V.score_of(metric, d)).alias("e"), d.alias("d")).collect():
        assert math.isclose(r.s, r.t, abs_tol=1e-9) and math.isclose(r.e, r.d, abs_tol=1e-9)


def test_tokeniser(spark):
    cases = {"The quick, brown FOX -- jumps!": "the quick brown fox jumps", "": "", "!!!...": "", "snake_case_name": "snake case name", "covid 19 and gpt4": "covid 19 and gpt4", "café Ünicode naïve": "café ünicode naïve", "a\t b\n\nc": "a b c"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, w string")
    for r in df.select("t", "w", tokens(F.col("t")).alias("x")).collect():
        assert r.x == r.w.split() == query_tokens(r.t)


def test_hand_bm25(spark):
    docs = spark.createDataFrame([(0, "cat dog"), (1, "cat cat bird"), (2, "fish"), (3, "!!!"), (4, ""), (5, None)], "id long, text string")
    three = bm25.indexed(docs.where("id < 3"))
    s = bm25.stats(three).first()
    assert (s.n_docs, s.total_len, s.avgdl) == (3, 6, 2.0)
    i = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    want = {0: i * 2.5 / (1 + 1.5), 1: i * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 1.5))}
    got = {r.id: r.score for r in bm25.search(three, "cat", 5).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}
    twice = {r.id: r.score for r in bm25.search(three, "cat cat", 5).collect()}
    assert all(math.isclose(twice[k], 2 * want[k], abs_tol=2e-6) for k in want)
    assert bm25.stats(bm25.indexed(docs)).first().n_docs == 4  # "!!!" counts with length 0, the empty and the missing text don't
    assert bm25.search(three, "", 5).count() == 0
    e = {r.term: r for r in bm25.explain(three, "cat unknown", 1).collect()}
    assert e["cat"].tf == 2 and e["unknown"].contribution == 0.0


def test_rrf(spark):
    r = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank long")
    rows = fusion.rrf({"dense": r("ab"), "sparse": r("cb")}).orderBy("rank").collect()
    assert rows[0].id == "b" and math.isclose(rows[0].score, 2 / 62, abs_tol=1e-9) and dict(rows[0].ranks) == {"dense": 2, "sparse": 2}
    assert [x.id for x in rows[1:]] == ["a", "c"]
    rows = fusion.rrf([r("aab")]).orderBy("rank").collect()  # a repeated id uses up a place
    assert [(x.id, x.best_rank) for x in rows] == [("a", 1), ("b", 3)] and "ranker_0" in rows[0].ranks
    numbers = spark.createDataFrame([(9, 1), (10, 1)], "id long, rank long")
    assert [x.id for x in fusion.rrf([numbers]).orderBy("rank").collect()] == [10, 9]
    with pytest.raises(model.InvalidRequest):
        fusion.rrf([r("a")], k=-1)


def test_kmeans_and_ivf(spark):
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((8, 16)) * 6
    x = np.concatenate([c + rng.standard_normal((60, 16)) for c in centres])
    out = ivf.kmeans(x, 8)
    assert len({tuple(np.unique(out["assignments"][i * 60 : (i + 1) * 60])) for i in range(8)}) >= 7
    assert len(ivf.kmeans(np.zeros((5, 3)), 3)["centroids"]) == 3 and len(ivf.kmeans(x[:2], 9)["centroids"]) == 2
    v = frame(spark, x)
    c = ivf.train(v, 8)
    lists = v.join(ivf.assign(v, c).select("id", "cid"), "id")
    q = v.where("id % 37 = 0")
    exact = {(r.qid, r.id, r.rank) for r in knn.knn(v, q, 5, "l2").collect()}
    assert exact == {(r.qid, r.id, r.rank) for r in ivf.search(lists, c, q, 5, 8).collect()}
    near = {(r.qid, r.id, r.rank) for r in ivf.search(lists, c, q, 5, 1).collect()}
    assert len(near & exact) > 0.7 * len(exact)
    dead = v.where("id % 2 = 0").select("id")
    assert all(r.id % 2 for r in ivf.search(lists, c, q, 5, 8, exclude=dead).collect())


def test_hnsw(spark):
    x = np.random.default_rng(42).standard_normal((600, 16))
    v = frame(spark, x)
    index = hnsw.build(v, "l2", 8, 60, shards=2).persist()
    q = v.where("id < 30")
    exact = {(r.qid, r.id) for r in knn.knn(v, q, 10, "l2").collect()}
    got = {(r.qid, r.id) for r in hnsw.search(index, q, 10, "l2", 64).collect()}
    assert len(got & exact) >= 0.95 * len(exact)
    dead = v.where("id % 3 = 0").select("id")
    assert all(r.id % 3 for r in hnsw.search(index, q, 10, "l2", 64, dead).collect())
    g = hnsw.Graph(Metric.L2, 8, 60).build(x[:200])
    g.validate()
    assert g.histogram()[0] == 200 and hnsw.edges(index).where("node = neighbour").count() == 0
    g = hnsw.Graph(Metric.L2, 2, 10).build(np.array([(0, 0), (1, 0), (1.05, 0.02), (0, 1.4)]))
    near = sorted((float(((g.x[i] - g.x[0]) ** 2).sum()), i) for i in (1, 2, 3))
    assert g._choose(near, 2) == [1, 3]
    with pytest.raises(model.InvalidRequest):
        hnsw.Graph(Metric.L2, 1)


def test_evaluation(spark):
    r = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "qid long, id long, rank long")
    t = spark.createDataFrame([(1, 11, 1), (1, 13, 2), (2, 12, 1)], "qid long, id long, rank long")
    g = t.select("qid", "id", F.lit(1.0).alias("gain"))
    assert {x.qid: x.recall for x in evaluate.recall_at_k(r, t, 10).collect()} == {1: 0.5, 2: 1.0}
    assert {x.qid: x.rr for x in evaluate.mrr_at_k(r, g, 10).collect()} == {1: 0.5, 2: 1.0}
    n = {x.qid: x.ndcg for x in evaluate.ndcg_at_k(r, g, 10).collect()}
    assert n[2] == 1.0 and math.isclose(n[1], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "vector": [1, 2.5], "metadata": {"a": 1}}\n\n{"id": "b", "vector": [3, 4]}\n')
    rows = {r.id: r for r in readers.read_items(spark, f"file://{p}").collect()}
    assert list(rows["1"].vector) == [1.0, 2.5] and rows["1"].metadata == '{"a":1}' and rows["b"].metadata == "{}"
    p.write_text('[{"id": "z", "vector": [1, 2]}]')
    assert readers.read_items(spark, f"file://{p}").first().id == "z"
    assert readers.parse_vector("1, 2") == readers.parse_vector("[1, 2]") == readers.parse_vector('{"vector": [1, 2]}') == [1.0, 2.0]
    for bad in ("", "x", '{"a": 1}'):
        with pytest.raises(model.InvalidRequest):
            readers.parse_vector(bad)
    with pytest.raises(model.InvalidRequest, match=":2"):
        readers.parse_items('{"id": 1, "vector": [1]}\nnot json\n')
    assert readers.gaussian(spark, 10, 4).count() == 10 and readers.zipf_text(spark, 5, 6, 50).count() == 5


def test_names():
    assert Metric.parse("COSINE") is Metric.COSINE and IndexType.parse("Ivf") is IndexType.IVF
    assert [fetch_size(10, False), fetch_size(5, True), fetch_size(50, True), fetch_size(500, True)] == [10, 100, 500, 1000]


def test_bad_lines_are_named(spark, tmp_path):
    f = tmp_path / "bad.jsonl"
    f.write_text('{"id": "a", "vector": [1]}\n\n{"id": "b"}\n')
    with pytest.raises(model.InvalidRequest, match=r"bad\.jsonl:3"):
        readers.read_items(spark, str(f))
    f.write_text('{"id": "a", "vector": [1]}\n{torn\n')
    with pytest.raises(model.InvalidRequest, match=r"bad\.jsonl:2"):
        readers.read_items(spark, str(f))


def test_generators_and_prefix(spark):
    rows = readers.clustered(spark, 60, 4, clusters=3, spread=0.1).collect()
    assert rows == readers.clustered(spark, 60, 4, clusters=3, spread=0.1).repartition(7).orderBy("id").collect()
    by = {label: np.mean([r.vector for r in rows if r.label == label], axis=0) for label in {r.label for r in rows}}
    assert all(min(by, key=lambda c: np.linalg.norm(by[c] - r.vector)) == r.label for r in rows)
    found = readers.topical(spark, 300, share=0.3).collect()
    assert 40 < sum(r.rare is not None for r in found) < 150 and all((f"rare{r.rare}" in r.text.split()) for r in found if r.rare is not None)
    corpus, queries = readers.prefix(spark.range(50), spark.range(9), 20, 4)
    assert corpus.count() == 20 and queries.count() == 4


def test_ground_truth_is_kept(spark, tmp_path):
    c, path = frame(spark, [(1, 0), (0, 1), (0.8, 0.6)]), f"{tmp_path}/truth"
    want = sorted(map(tuple, evaluate.ground_truth(c, c, 2, "l2", path).collect()))
    assert want == sorted(map(tuple, evaluate.ground_truth(c.limit(0), c, 2, "l2", path).collect())) and len(want) == 6
