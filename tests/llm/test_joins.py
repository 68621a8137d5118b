"""The n-gram join, mixing and the pipeline against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairn.llm import common, mixing, njaccard, queries
from compare import same


def brute(rows, n, t):
    sets = []
    for i, text in rows:
        g, at = njaccard.gram_sets([text], n)
        sets.append((i, set(g.tolist())))
    out = {}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b:
                s = len(a & b) / len(a | b)
                if s >= t - 1e-12:
                    out[i, j] = round(s, 6)
    return out


def family(seed: int, groups: int = 60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 80, 300]))]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 10])):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
            rows.append((len(rows), " ".join(w)))
    return rows


def roots(nodes, edges):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return {i: find(i) for i in nodes}


def between_classes(want):
    """Of all pairs those of classes of equal sets, each class being its least id; and the class of the ids that have one."""
    least = {}
    for (i, j), s in sorted(want.items()):
        if s == 1:
            least[j] = min(least.get(j, j), least.get(i, i))
    return {(i, j): s for (i, j), s in want.items() if s < 1 and i not in least and j not in least}, least


def check_classes(got, ids, want):
    between, least = between_classes(want)
    root = roots(ids, want)
    n = {i: sum(i in p for p in between) for i in ids}
    assert got == sorted((i, root[i], least.get(i, i), n[least.get(i, i)]) for i in ids)


@pytest.mark.parametrize("n,t", [(2, 0.75), (1, 0.6), (3, 0.9)])
def test_pairs_equal_brute_force(spark, n, t):
    rows = family(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, n, t)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in njaccard.pairs(df, n, t).collect()}
    assert got == between_classes(want)[0]
    check_classes(sorted(map(tuple, njaccard.classes(df, n, t).collect())), [i for i, _ in rows], want)


def test_hot_keys_are_split(spark, monkeypatch):
    """The same pairs when almost every key counts as hot."""
    rows = family(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    g, at = njaccard.gram_sets([t for _, t in rows], 2)
    sketch = np.random.default_rng(1).integers(0, 9, njaccard.SKETCH)
    for hot in (1, 1000):
        monkeypatch.setattr(njaccard, "HOT", hot)
        s = njaccard.Schemes(0.75, 1 << 20)
        key, r = njaccard.records(s, sketch, g, at, np.arange(1, len(at)).astype(np.uint64) << np.uint64(24))
        r["key"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        found = {p for g in njaccard.matches(r) for p in itertools.combinations(g.tolist(), 2)}
        want = {(i + 1, j + 1) for (i, j), v in brute(rows, 2, 0.75).items()}
        assert want <= found
    monkeypatch.setattr(njaccard, "HOT", 1)
    assert {(r.doc_a, r.doc_b) for r in njaccard.pairs(df).collect()} == set(between_classes(brute(rows, 2, 0.75))[0])


def test_classes_of_the_table(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_classes(sorted(map(tuple, njaccard.classes(docs).collect())), [i for i, _ in rows], brute(rows, njaccard.N, njaccard.THRESHOLD))


def test_classes_equal_sql(spark, sf_dir):
    same(queries.QUERIES["op10_ngram_jaccard"](spark, sf_dir), queries.SQL["op10_ngram_jaccard"], sf_dir)


def test_large_components_are_cut(spark, monkeypatch):
    """The same pairs when connected sets are cut into many blocks."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if (j * 7 + i) % 61 else f"x{i}" for j, w in enumerate(words))) for i in range(50)] + [(100 + i, t) for i, t in family(6, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = between_classes(brute(rows, 2, 0.75))[0]
    assert len(want) > 500
    for dense in (0.25, 2.0):  # as groups, and as pairs
        monkeypatch.setattr(njaccard, "DENSE", dense)
        monkeypatch.setattr(njaccard, "CELL", 7)
        assert {(r.doc_a, r.doc_b): r.jaccard for r in njaccard.pairs(df).collect()} == want


def test_shared_references_lose_nothing(spark, monkeypatch):
    """Sets whose references collide are compared all the same."""
    rows = family(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(njaccard, "REF", 5)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in njaccard.pairs(df).collect()} == between_classes(brute(rows, 2, 0.75))[0]


def test_index_entries_are_not_compared_with_each_other(monkeypatch):
    """A key that very many sets have and few look up costs what the lookups do."""
    n, compared = 6000, []
    r = np.zeros(n, njaccard._RECORD)
    r["low"] = np.arange(n)
    maps = np.random.default_rng(1).integers(0, 1 << 41, n).astype(np.uint64) << np.uint64(njaccard.MAPS)
    r["rest"] = (maps | np.uint64(njaccard.INDEX)) << np.uint64(8)
    follows = njaccard._follows
    monkeypatch.setattr(njaccard, "_follows", lambda x, y, probe: compared.append(len(x)) or follows(x, y, probe))
    assert njaccard.matches(r) == [] and sum(compared) == 0
    r["rest"][7] |= np.uint64(njaccard.PROBE << 8)
    maps[9] = maps[7]
    r["rest"][9] = r["rest"][9] & np.uint64(255) | (maps[9] | np.uint64(njaccard.INDEX)) << np.uint64(8)
    assert [7, 9] in [g.tolist() for g in njaccard.matches(r)] and sum(compared) < n


def test_cost_of_keys_is_free_of_chance():
    """A sketch that is full of other keys' counts, as that of a large corpus is, changes no threshold."""
    g, at = njaccard.gram_sets([t for _, t in family(5)], 2)
    s, sig = njaccard.Schemes(0.75, 1 << 20), np.arange(1, len(at)).astype(np.uint64) << np.uint64(24)
    empty, full = (njaccard.records(s, np.full(njaccard.SKETCH, c), g, at, sig) for c in (0, 100))
    assert len(empty[0]) == len(full[0]) and (empty[0] == full[0]).all()
    assert all((empty[1][c] == full[1][c]).all() for c in ("low", "rest"))  # keys are filled in later


@pytest.mark.parametrize("cross", [False, True])
def test_products_equal_lookups(monkeypatch, cross):
    sets = [np.unique(np.random.default_rng(i).permutation(40)[: 30 + i % 9]).astype(np.uint64) for i in range(90)] + [np.arange(900, 930, dtype=np.uint64)]
    sigs, blocks = np.sort(np.arange(91) // 2 * 2), np.arange(91) % 2 + 3
    monkeypatch.setattr(njaccard, "PRODUCT_ROWS", 7)
    monkeypatch.setattr(njaccard, "PRODUCT_COLUMNS", 11)
    found = []
    for product, wanted in ((0, 1 << 20), (0, 500), (10**9, 1)):
        monkeypatch.setattr(njaccard, "PRODUCT", product)
        monkeypatch.setattr(njaccard, "WANTED", wanted)
        found.append(sorted((i, j, s) for part in njaccard.verified(sigs, sets, blocks, [np.unique(sigs)], cross, 0.6) for i, j, s in zip(*(x.tolist() for x in part))))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert all(i < j and (not cross or blocks[i] != blocks[j]) for i, j, _ in found[0])


def test_links_grow_with_the_sets(spark):
    """Many near copies, one document with two of the texts among them: links are counted where they are found, not written pair by pair."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if (j * 7 + i) % 61 else f"x{i}" for j, w in enumerate(words))) for i in range(120)]
    rows += [(0, rows[50][1]), (0, rows[0][1] + " more"), (130, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, text string")
    assert njaccard.class_pairs(df, 2, 0.75)[1].count() > 5000
    assert njaccard.class_pairs(df, 2, 0.75, counted=True)[1].count() < 5 * len(rows)
    near = {(r.a, r.b) for r in njaccard.class_pairs(df, 2, 0.75)[1].collect()}
    got = {r.doc_id: r for r in njaccard.classes(df, key="id").collect()}
    assert {r.class_id for r in got.values()} == {0} and got[50].copy_of == 0
    assert all(got[i].n_links == sum(i in p for p in near) for i in range(1, 120) if got[i].copy_of == i)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(4, 120), st.integers(0, 30))
def test_candidates_hold_every_pair(seed, size, changes):
    """The lookups of two sets meet whenever the sets are similar, whatever the sketch says."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    drop = rng.integers(0, 2, 1)[0]
    b = np.unique(np.concatenate([a[min(changes, len(a) - 1) * drop :], rng.integers(0, 2**63, changes * (1 - drop)).astype(np.uint64)]))
    same_ = len(np.intersect1d(a, b))
    if same_ / (len(a) + len(b) - same_) < njaccard.THRESHOLD or np.array_equal(a, b):
        return
    s = njaccard.Schemes(njaccard.THRESHOLD, 1 << 20)
    sketch = rng.integers(0, 100, njaccard.SKETCH)
    at = np.array([0, len(a), len(a) + len(b)])
    keys, r = njaccard.records(s, sketch, np.concatenate([a, b]), at, np.array([1 << 24, 2 << 24], np.uint64))
    r["key"] = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    assert [g.tolist() for g in njaccard.matches(r)] == [[1, 2]]


def test_one_of_each_group_stays(spark):
    rows = family(11)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keeper string")
    root = roots([i for i, _ in rows], brute(rows, njaccard.N, njaccard.THRESHOLD))
    kept = njaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)


def test_join_odd(odd, none):
    got = sorted(map(tuple, njaccard.classes(odd).collect()))
    assert got == [(i, 5 if i in (6, 7) else i, 5 if i in (6, 7) else i, 0) for i in range(1, 11)]
    assert njaccard.pairs(odd).count() == 0
    assert njaccard.pairs(none).count() == 0 and njaccard.classes(none).count() == 0 and njaccard.keep_one(none).count() == 0
    kept = sorted((r.doc_id for r in njaccard.keep_one(odd).collect()), key=lambda x: (x is None, x))
    assert kept == [1, 2, 3, 4, 5, 5, 8, 9, 10, None]  # a null id has no partner; the repeated row is the same document


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


# -- 5 mixing


def test_mixing_equals_sql(spark, sf_dir):
    same(queries.QUERIES["op5_mixing"](spark, sf_dir), queries.SQL["op5_mixing"], sf_dir)


def test_schedule_is_followed(spark):
    rows = [(i, "x" * 40, "abc"[i % 3] if i % 2 else "a") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedule = {"a": [(0.0, 0.8), (1.0, 0.2)], "b": [(0.0, 0.1), (1.0, 0.4)], "c": [(0.0, 0.1), (1.0, 0.4)]}
    got = mixing.positions(df, schedule).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    total = sum(r.tokens for r in got)
    for lo in (0.0, 0.25, 0.5, 0.75):
        mid = lo + 0.125
        part = [r for r in got if lo <= r.position < lo + 0.25]
        assert abs(sum(r.tokens for r in part) / total - 0.25) < 0.02
        for s, ((_, x), (_, y)) in schedule.items():
            assert abs(sum(r.tokens for r in part if r.source == s) / sum(r.tokens for r in part) - (x + (y - x) * mid)) < 0.03


def test_mixing_odd(odd, none):
    assert mixing.positions(none).count() == 0 and mixing.mix(none).count() == 0
    got = mixing.mix(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))


def test_mixing_joins_alike_at_any_size(spark, monkeypatch):
    """Null and empty ids are told apart, whether positions are broadcast or not."""
    df = spark.createDataFrame([(None, "x", "s"), ("", "y", "s"), ("b", "z", "s")], "doc_id string, text string, source string")
    for bound in (10, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        assert sorted(r.text for r in mixing.mix(df).collect()) == ["x", "y", "z"]


def test_scarce_source_removes_nothing(spark):
    rows = [(i, "x" * 40, "big") for i in range(3000)] + [(3000 + i, "x" * 40, "mid") for i in range(1000)] + [(4000, "x", "stray"), (4001, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == list(range(4002))
    got = mixing.positions(df, whole=True).collect()
    assert sorted(r.doc_id for r in got) == list(range(4002)) and all(0 <= r.position <= 1 for r in got)
    # each source's course over time is its schedule's
    schedule = mixing.shares_schedule({s: sum(r.tokens for r in got if r.source == s) for s in {r.source for r in got}})
    for s in ("big", "mid"):
        first, second = (sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in [schedule[s][i : i + 2]]) for i in (0, 1))
        assert abs(np.mean([r.position < 0.5 for r in got if r.source == s]) - first / (first + second)) < 0.01


# -- pipeline


def test_pipeline(spark, sf_dir, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    now, seen = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = now
        if name != names[-1]:
            assert now.columns == docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic}
    left = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(toxic & left) <= 0.6 * len(toxic) and len(left) >= docs.count() - len(toxic) - 0.02 * docs.count()
    rows = [(r.doc_id, r.text) for r in seen["near_duplicates"].collect()]
    assert not brute(rows, njaccard.N, njaccard.THRESHOLD)
    assert {r.doc_id for r in seen["encoding"].collect()} == {r.doc_id for r in seen["mixing"].collect()}
    again = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.n_tokens for r in seen["encoding"].collect()}


def test_encoding_keeps_the_order_of_the_mix(spark, docs, sf_dir, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    corpus_pipeline.mix_sources(spark, docs, sf_dir).repartitionByRange(5, "n_chars").write.parquet(f"{tmp_path}/other")
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in mixing.positions(docs, whole=True).collect()]
    mixed, other = ([r.doc_id for r in corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/{x}"), sf_dir).orderBy("place").collect()] for x in ("mixed", "other"))
    assert mixed == order and other != order and sorted(other) == sorted(order)


@pytest.mark.parametrize("which", [0, 1, 2, 3, 4])
def test_stages_odd(spark, odd, none, sf_dir, which):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name, stage = corpus_pipeline.STAGES[which]
    for df in (odd, none):
        out = stage(spark, df, sf_dir)
        assert out.count() <= df.count()
        assert name == "encoding" or out.columns == df.columns
