"""Inverted lists: k-means centroids, assignment, probing search, and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.vector import EPS, scores
from cairn.model import InvalidRequest, Metric
from cairn.operators import knn

NLIST, NPROBE, ITERATIONS, TOLERANCE, SAMPLE, SEED = 256, 16, 25, 1e-4, 100_000, 42


def _bring(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (cid, vector) on the driver: there are nlist of them, whatever the corpus."""
    rows = sorted(centroids.select("cid", "vector").collect(), key=lambda r: r.cid)
    return np.array([r.cid for r in rows], np.int64), np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)


def _distances(metric: Metric, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = scores(metric, x, c)
    return s * s if metric is Metric.L2 else (1 - s if metric is Metric.COSINE else -s)


def assign(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    """(id, cid, distance) of the nearest centroid of every row; ties go to the lower cid. No shuffle."""
    metric = Metric.parse(metric)
    cids, c = _bring(centroids)
    schema = pa.schema([("id", pa.int64()), ("cid", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        for batch in batches:
            d = np.round(_distances(metric, knn.matrix(batch.column(1)), c), 9) if batch.num_rows else np.zeros((0, len(cids)))
            best = d.argmin(1) if len(cids) and len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids[best]), pa.array(d[np.arange(len(best)), best])], schema=schema)

    return vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "id long, cid long, distance double")


def assigned(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    """(id, vector, cid) of every row, without a join."""
    metric = Metric.parse(metric)
    cids, c = _bring(centroids)
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("cid", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                best = np.round(_distances(metric, knn.matrix(batch.column(1)), c), 9).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema[1].type), pa.array(cids[best])], schema=schema)

    return vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "id long, vector array<double>, cid long")


def write_lists(vectors: DataFrame, centroids: DataFrame, metric: Metric | str, path: str) -> None:
    """The rows as packed blocks, a folder a centroid: a search reads the folders that it probes."""
    rows = assigned(vectors, centroids, metric).repartition("cid").sortWithinPartitions("cid", "id")
    knn.pack(rows, "x", "cid").write.partitionBy("cid").parquet(path)


def read_lists(spark, paths: list[str]) -> DataFrame:
    """(x_ids, x_vectors, cid) blocks of one or more written lists."""
    frames = [spark.read.schema("x_ids binary, x_vectors binary, cid long").parquet(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def lloyd_step(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    """(cid, vector): the means of the clusters, in one pass; each task sends sums of nlist vectors. Empty ones keep their place."""
    metric = Metric.parse(metric)
    cids, c = _bring(centroids)
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        n, sums = np.zeros(len(cids), np.int64), np.zeros_like(c)
        for batch in batches:
            if batch.num_rows:
                x = knn.matrix(batch.column(0))
                best = np.round(_distances(metric, x, c), 9).argmin(1)
                n += np.bincount(best, minlength=len(cids))
                np.add.at(sums, best, x)
        yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(n), pa.array(sums.tolist(), schema[2].type)], schema=schema)

    parts = vectors.select(F.col("vector").cast("array<double>")).mapInArrow(run, "cid long, n long, sums array<double>")
    total = parts.select("cid", "n", F.posexplode("sums").alias("pos", "x")).groupBy("cid", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    old = centroids.select("cid", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "old"))
    mean = old.join(total, ["cid", "pos"], "left").withColumn("v", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.col("old")))
    out = mean.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vector"))
    if metric is Metric.COSINE:
        from cairn.functions.vector import normalize

        out = out.select("cid", normalize(F.col("vector")).alias("vector"))
    return out


def inertia(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    return assign(vectors, centroids, metric).agg(F.sum("distance").alias("inertia"))


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next seed is drawn in proportion to the squared distance to the nearest seed."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        nxt = int(rng.choice(len(x), p=near / total)) if total > 0 else int(np.setdiff1d(np.arange(len(x)), chosen)[0])
        chosen.append(nxt)
        near = np.minimum(near, ((x - x[nxt]) ** 2).sum(1))
    return x[chosen].copy()


def kmeans(x: np.ndarray, k: int, metric: Metric = Metric.L2, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, seed: int = SEED) -> dict:
    """Lloyd's algorithm on a sample in memory; empty clusters take the worst-served points; cosine centroids stay on the sphere."""
    if len(x) == 0 or k <= 0:
        raise InvalidRequest("k-means needs rows and a positive k")
    rng, k = np.random.default_rng(seed), min(k, len(x))
    c, last, done, i = seeds(x, k, rng), np.inf, False, 0
    for i in range(1, iterations + 1):
        d = _distances(metric, x, c)
        to = d.argmin(1)
        cost = d[np.arange(len(x)), to]
        n = np.bincount(to, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-cost, kind="stable")[: len(empty)]]
        if metric is Metric.COSINE:
            c /= np.maximum(np.linalg.norm(c, axis=1), EPS)[:, None]
        total = float(cost.sum())
        if abs(last - total) <= tolerance * max(abs(last), EPS) if np.isfinite(last) else False:
            done = True
            break
        last = total
    d = _distances(metric, x, c)
    return {"centroids": c, "assignments": d.argmin(1), "inertia": float(d.min(1).sum()), "iterations": i, "converged": done}


#: Numbers of a training sample that the driver holds at most (400 MB); a larger one is clustered by distributed steps.
DRIVER_NUMBERS = 50_000_000


def train(vectors: DataFrame, nlist: int = NLIST, metric: Metric | str = Metric.L2, iterations: int = ITERATIONS, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(cid, vector) centroids learnt on at most ``sample`` rows, drawn by a hash of the id.

    The driver seeds and iterates on as many of them as it may hold; what is beyond that takes part in Lloyd steps over the whole sample.
    """
    metric = Metric.parse(metric)
    width = (vectors.select(F.size("vector")).first() or [1])[0] or 1
    held = max(nlist, min(sample, DRIVER_NUMBERS // width))
    drawn = vectors.select("id", "vector").orderBy(F.xxhash64("id"), "id")
    x = knn.matrix(drawn.limit(held).select(F.col("vector").cast("array<double>")).toArrow().column(0).combine_chunks())
    c = kmeans(x, nlist, metric, iterations, seed=seed)["centroids"]
    made = vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cid long, vector array<double>")
    if held < sample:
        from cairn.session import stored

        rows = stored(drawn.limit(sample), "sample")
        for _ in range(3):
            made = stored(lloyd_step(rows, made, metric), "centroids")
    return made


def search(lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int | None = NPROBE, metric: Metric | str = Metric.L2, pending: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) from lists, probing each query's nearest centroids, and all ``pending`` rows (id, vector).

    The lists are written blocks (x_ids, x_vectors, cid), of which only those of probed centroids are read, or rows (id, vector, cid).
    A few queries are packed and meet the blocks of the lists that they probe in an equi-join on the centroid; many are spread over cells (``knn.cells``),
    so no task has a whole list's work. A search that probes every list is an exact one over their rows.
    """
    from cairn.session import BROADCAST_IDS, by_ids

    metric = Metric.parse(metric)
    if k <= 0:
        raise InvalidRequest("k must be positive")
    cids, c = _bring(centroids)
    nprobe = max(1, min(nprobe or NPROBE, len(cids))) if len(cids) else 0
    packed, dead = "x_ids" in lists.columns, None
    if nprobe == len(cids):
        rows = (knn.unpack(lists, "x", "cid") if packed else lists).select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
        if pending is not None:
            rows = rows.union(pending.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")))
        return knn.knn(rows, queries, k, metric, exclude)
    if exclude is not None:
        pending = by_ids(pending, exclude, "id", "left_anti") if pending is not None else None
        if packed and exclude.count() <= BROADCAST_IDS:
            dead = np.sort(np.array([r[0] for r in exclude.collect()], np.int64))  # as many as the bound says
        else:
            lists, packed = by_ids(knn.unpack(lists, "x", "cid") if packed else lists, exclude, "id", "left_anti"), False
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("cid", pa.int64())])

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(np.round(_distances(metric, knn.matrix(batch.column(1)), c), 9), axis=1, kind="stable")[:, :nprobe]
                at = pa.array(np.repeat(np.arange(batch.num_rows), nprobe))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at).cast(schema[1].type), pa.array(cids[order.ravel()])], schema=schema)

    probes = queries.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(probe, "id long, vector array<double>, cid long")
    size, n = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.count("*")).first()
    asked = {r["cid"]: r["count"] for r in probes.groupBy("cid").count().collect()}  # as many rows as there are lists, at most
    if packed:
        lists = lists.where(F.col("cid").isin(list(asked)))
    sizes, heavy = {}, size * nprobe > knn.LIGHT_WORK // (8 * knn.BLOCK)  # for fewer the lists' rows aren't counted
    if heavy:
        rows = lists.groupBy("cid").agg((F.sum(F.length("x_ids")) / 8 if packed else F.count("*")).cast("long").alias("n"))
        sizes = {r["cid"]: (r["n"], asked[r["cid"]]) for r in rows.collect() if r["cid"] in asked}
        heavy = sum(a * b for a, b in sizes.values()) * c.shape[1] > knn.LIGHT_WORK or size * nprobe > knn.BROADCAST_NUMBERS
    if heavy:
        rows = knn.unpack(lists, "x", "cid") if packed else lists
        if dead is not None:
            rows = by_ids(rows, exclude, "id", "left_anti")
        by = F.col("cid").alias("by")
        found = knn.cells_top_k(*knn.alike(knn.plain(rows, by), knn.plain(probes, by)), sizes, c.shape[1], k, metric)
    else:
        q = F.broadcast(knn.pack(probes, "q", "cid"))
        found = knn.block_top_k((lists if packed else knn.pack(lists, "x", "cid")).join(q, "cid"), k, metric, dead)
    if pending is not None:
        found = found.union(knn.knn(pending, queries, k, metric).drop("rank"))
    return knn.ranked(found, k, metric)


def bucket_stats(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row (n_buckets, min_size, max_size, mean_size), empty buckets included."""
    n = centroids.select("cid").join(assigned.groupBy("cid").count(), "cid", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("n_buckets"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
