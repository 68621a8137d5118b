import re

import numpy as np
import pytest

from cairn.plans import catalogue
from compare import same


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


def test_levels_fall(spark, sf_dir):
    rows = {r.layer: r.nodes for r in catalogue.QUERIES["hnsw_levels"](spark, sf_dir).collect()}
    assert rows[0] == catalogue.vectors(spark, sf_dir).count()
    assert all(rows[i] >= rows[i + 1] for i in range(len(rows) - 1))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_default_beam_finds_neighbours(spark, sf_dir):
    """hnsw_ef64 against brute force over the whole table."""
    rows = sorted(catalogue.vectors(spark, sf_dir).collect())
    ids, x = np.array([r.id for r in rows]), np.array([r.vector for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = {int(q): set(ids[np.lexsort((ids, -np.round(x @ v, 6)))[:10]].tolist()) for q, v in zip(ids, x)}
    found = {int(q): set() for q in ids}
    for r in catalogue.QUERIES["hnsw_ef64"](spark, sf_dir).collect():
        found[r.qid].add(r.internal_id)
    assert np.mean([len(found[q] & true[q]) / len(true[q]) for q in true]) >= 0.95


def test_levels_equal_the_draw(spark, sf_dir):
    """The histogram follows from the seeded draws of each shard's levels."""
    import math

    from pyspark.sql import functions as F

    sizes = [r["count"] for r in catalogue.vectors(spark, sf_dir).groupBy(F.pmod(F.xxhash64("id"), F.lit(4)).alias("s")).count().collect()]
    want = {}
    for n in sizes:
        rng = np.random.default_rng(42)
        for _ in range(n):
            for layer in range(int(-math.log(max(rng.random(), 1e-300)) / math.log(16)) + 1):
                want[layer] = want.get(layer, 0) + 1
    assert {r.layer: r.nodes for r in catalogue.QUERIES["hnsw_levels"](spark, sf_dir).collect()} == want


def test_probing_reads_fewer_lists(spark, sf_dir):
    """Folders of centroids that nobody probes aren't read."""
    from cairn.operators import ivf

    lists, c = catalogue._stored_lists(spark, sf_dir, "all")
    q = catalogue.first(catalogue.vectors(spark, sf_dir))
    plans = [ivf.search(lists, c, q, 10, n, "l2")._jdf.queryExecution().executedPlan().toString() for n in (1, 10_000)]
    filters = [re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", p) for p in plans]
    named = [any(re.search(r"cid#\d+L? (= |IN \()\d", f) for f in some) for some in filters]
    assert named == [True, False]


def test_distributed_training(spark, monkeypatch):
    """A sample beyond what the driver holds takes part in distributed steps."""
    from cairn.operators import ivf

    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 0.1 + 10 * (i % 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    monkeypatch.setattr(ivf, "DRIVER_NUMBERS", 4 * 60)
    got = sorted(round(sum(r.vector) / 4) for r in ivf.train(df, 3, "l2", sample=300).collect())
    assert got == [0, 10, 20]
