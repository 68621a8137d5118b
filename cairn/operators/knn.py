"""Exact nearest neighbours of many queries.

A few queries are packed and broadcast, and meet blocks of the corpus in Arrow batches. Many queries are spread over cells: the corpus and the
queries are cut by a hash of the id, and each cell holds one part of the corpus while one part of the queries streams past it. Parts are copied
so that every query meets every row once; a cell's memory and work are bounded whatever the tables' sizes, and it gives the k best of each of
its queries only.

Scores are screened in single precision against a bound with a proven margin; what may be among the k best is scored in double precision.
Scores are rounded to 6 decimals before ranking, ties go to the lower id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.vector import EPS, scores
from cairn.model import InvalidRequest, Metric

BLOCK = 8192
#: Numbers in the packed queries up to which they are broadcast (64 MB).
BROADCAST_NUMBERS = 8_000_000
#: Multiplications up to which the broadcast way is taken: few queries, or a small corpus.
LIGHT_WORK = 10_000_000_000
#: What a cell holds of the corpus and multiplies at most (64 MB in double precision; about 20 s), and multiplies at least if there are cores to spare.
CELL_NUMBERS, CELL_WORK, LEAST_WORK = 8_000_000, 250_000_000_000, 2_000_000_000
#: Multiplications of a cell that gives all its pairs.
PAIRS_WORK = 6_400_000_000
#: Columns and scores of a screened block.
SCREEN, SCREENED = 4096, 2_000_000


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """The rows of a column of equally long arrays; ``kind`` None leaves their type."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None else flat.astype(kind)).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pack(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """(by, {name}_ids, {name}_vectors) blocks of the frame (id, vector, by); ids and vectors are raw bytes."""
    kinds = ([(by, pa.int64())] if by else []) + [(f"{name}_ids", pa.binary()), (f"{name}_vectors", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            keys = batch.column(2).to_numpy(zero_copy_only=False) if by else np.zeros(len(ids), np.int64)
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
                for a in range(0, len(part), BLOCK):
                    p = part[a : a + BLOCK]
                    row = ([[int(keys[p[0]])]] if by else []) + [[ids[p].astype(np.int64).tobytes()], [x[p].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    ddl = ", ".join(([f"{by} long"] if by else []) + [f"{name}_ids binary", f"{name}_vectors binary"])
    return df.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), *([F.col(by).cast("long")] if by else [])).mapInArrow(run, ddl)


def unpack(blocks: DataFrame, name: str, by: str) -> DataFrame:
    """The rows (id, vector, by) of packed blocks."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), (by, pa.int64())])

    def run(batches):
        for batch in batches:
            for i, v, key in zip(*(batch.column(j).to_pylist() for j in range(3))):
                ids, x = np.frombuffer(i, np.int64), np.frombuffer(v, np.float64)
                offs = np.arange(len(ids) + 1, dtype=np.int32) * (len(x) // max(len(ids), 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x)), pa.array(np.full(len(ids), key))], schema=schema)

    return blocks.select(f"{name}_ids", f"{name}_vectors", by).mapInArrow(run, f"id long, vector array<double>, {by} long")


class Held:
    """Rows that many queries are scored against. ``screen`` holds them in single precision, in double if their numbers are extreme."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: Metric):
        self.ids, self.x, self.metric = ids, x, metric
        self.far = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        self.middle = x.mean(axis=0, dtype=np.float64) if metric is Metric.L2 else None
        kind = np.float32 if len(x) and self.far.max() < 1e15 else np.float64
        if metric is Metric.COSINE:
            y = (x / np.maximum(self.far, EPS)[:, None]).astype(kind)
        elif metric is Metric.L2:  # |x|^2 - 2 q x, about the middle so that single precision serves distances
            y = x - self.middle
            sq = np.einsum("ij,ij->i", y, y)
            self.most = float(np.sqrt(sq.max())) if len(x) else 0.0
            y = np.concatenate([y, sq[:, None]], axis=1).astype(kind)
        else:
            y = x.astype(kind, copy=False)
        self.screen, self.unit = y, float(np.finfo(kind).eps) * (x.shape[1] + 16)

    def exact(self, q: np.ndarray, norms: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Rounded scores of the pairs (row of q, row held)."""
        out = np.empty(len(r))
        step = max(1, 1_000_000 // max(q.shape[1], 1))
        for a in range(0, len(r), step):
            i, j = r[a : a + step], c[a : a + step]
            u, v = q[i], self.x[j].astype(np.float64, copy=False)
            if self.metric is Metric.L2:
                u = u - v
                out[a : a + step] = np.sqrt(np.einsum("ij,ij->i", u, u))
            else:
                t = np.einsum("ij,ij->i", u, v)
                out[a : a + step] = t / (np.maximum(norms[i], EPS) * np.maximum(self.far[j], EPS)) if self.metric is Metric.COSINE else t
        return np.round(out, 6) + 0.0

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, score) of the k best of every query, by (score, id)."""
        q = q.astype(np.float64, copy=False)
        norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        kind, n = self.screen.dtype, len(q)
        if n and norms.max() >= 1e15:
            kind = np.dtype(np.float64)
        if self.metric is Metric.L2:
            z = q - self.middle
            own = np.einsum("ij,ij->i", z, z)
            margin = self.unit * (self.most**2 + 2 * np.sqrt(own) * self.most + own)
            z = np.concatenate([-2 * z, np.ones((n, 1))], axis=1).astype(kind)
            widen = lambda o: (np.sqrt(np.maximum(o + own, 0)) + 1.1e-6) ** 2 - own
        else:
            own = np.zeros(n)
            margin = self.unit * (np.ones(n) if self.metric is Metric.COSINE else norms * (self.far.max() if len(self.far) else 0.0))
            z = -(q / np.maximum(norms, EPS)[:, None] if self.metric is Metric.COSINE else q).astype(kind)
            widen = lambda o: o + 1.1e-6
        bound = np.full(n, np.inf)  # of the k-th best found so far, in the screen's terms
        rows, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(self.x), SCREEN):
            o = z @ self.screen[a : a + SCREEN].T.astype(kind, copy=False)
            limit = bound.copy()
            for tighten in (not np.isfinite(bound).all(), True):
                if tighten and o.shape[1] >= k:
                    here = np.partition(o, k - 1, axis=1)[:, k - 1].astype(np.float64)
                    limit = np.minimum(limit, widen(here + margin))
                r, c = np.nonzero(o <= np.nextafter((limit + margin).astype(kind), kind.type(np.inf))[:, None])
                if len(r) <= 4 * k * n:
                    break
            if not len(r):
                continue
            rows, ids, score = np.concatenate([rows, r]), np.concatenate([ids, self.ids[a + c]]), np.concatenate([score, self.exact(q, norms, r, a + c)])
            by = np.lexsort((ids, score if self.metric.ascending else -score, rows))
            rows, ids, score = rows[by], ids[by], score[by]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, ids, score = rows[kept], ids[kept], score[kept]
            last = np.flatnonzero(np.diff(rows, append=n))
            full = last[last - np.searchsorted(rows, rows[last]) == k - 1]
            bound[rows[full]] = (score[full] + 1.1e-6) ** 2 - own[rows[full]] if self.metric is Metric.L2 else 1.1e-6 - score[full]
        return rows, ids, score


_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _found(held: Held, qi: np.ndarray, q: np.ndarray, k: int):
    """Arrow batches (qid, id, score) of the k best held rows of the queries."""
    step = max(1, SCREENED // max(1, min(SCREEN, len(held.ids))))
    for a in range(0, len(qi) if len(held.ids) else 0, step):
        r, i, s = held.nearest(q[a : a + step], k)
        yield pa.RecordBatch.from_arrays([pa.array(qi[a : a + step][r]), pa.array(i), pa.array(s)], schema=_FOUND)


def block_top_k(pairs: DataFrame, k: int, metric: Metric, dead: np.ndarray | None = None) -> DataFrame:
    """(qid, id, score): the k best of each query in each pair of packed blocks. ``dead``: sorted ids that don't count."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                qi, qv, xi, xv = (np.frombuffer(batch.column(j)[row].as_buffer(), t) for j, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
                q, x = qv.reshape(len(qi), -1), xv.reshape(len(xi), -1)
                if dead is not None and len(dead):
                    lives = dead[np.minimum(np.searchsorted(dead, xi), len(dead) - 1)] != xi
                    xi, x = xi[lives], x[lives]
                yield from _found(Held(xi, x, metric), qi, q, k) if len(xi) else ()

    return pairs.select("q_ids", "q_vectors", "x_ids", "x_vectors").mapInArrow(run, "qid long, id long, score double")


def cells(x: DataFrame, q: DataFrame, sizes: dict[int, tuple[int, int]], width: int, make, ddl: str, work: int = CELL_WORK) -> DataFrame:
    """What ``make`` gives for the rows x (id, vector, by) and queries q (id, vector, by) of the same ``by``, each pair in one cell.

    ``sizes``: rows and queries by ``by``. ``make(ids, vectors, batches of (query ids, query vectors))`` yields Arrow batches.
    """
    spark = x.sparkSession
    total, least, plan, n = sum(a * b for a, b in sizes.values()) * width, 2 * spark.sparkContext.defaultParallelism, [], 0
    for by, (nx, nq) in sorted(sizes.items()):
        mine = nx * nq * width
        if mine:
            m = max(-(-mine // work), min(-(-mine * least // total), -(-mine // min(LEAST_WORK, max(1, work // 32)))))
            gx = max(1, -(-nx * width // CELL_NUMBERS), min(m, round((m * nx / nq) ** 0.5)))
            gq = max(1, -(-m // gx))
            plan.append((by, gx, gq, n))
            n += gx * gq
    parts = max(1, min(n, max(least, -(-total // work))))
    grid = F.broadcast(spark.createDataFrame(plan, "by long, gx long, gq long, first long"))  # a row a list
    zero = F.lit(0).cast("long")
    copies = lambda most, step: F.explode(F.sequence(zero, most, step)).alias("o")
    held = x.join(grid, "by").select("id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("gx")) * F.col("gq")).alias("cell"), copies(F.col("gq") - 1, F.lit(1).cast("long")), F.lit(0).alias("side"))
    asked = q.join(grid, "by").select("id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("gq"))).alias("cell"), copies((F.col("gx") - 1) * F.col("gq"), F.col("gq")), F.lit(1).alias("side"))
    both = held.union(asked).select((F.col("cell") + F.col("o")).alias("cell"), "side", "id", "vector")

    def run(batches):
        def segments():
            for batch in batches:
                cell, side = (batch.column(j).to_numpy() for j in (0, 1))
                cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield (int(cell[a]), int(side[a])), batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a), None)

        ids, vectors, at = [], [], None
        for (cell, side), parts in itertools.groupby(segments(), lambda s: s[0]):
            if side == 0:
                ids, vectors, at = [], [], cell
                for _, i, v in parts:
                    ids.append(i)
                    vectors.append(v)
            elif cell == at:
                i, v = np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [], []
                yield from make(i, v, ((i, v) for _, i, v in parts))

    return both.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side").mapInArrow(run, ddl)


def cells_top_k(x: DataFrame, q: DataFrame, sizes: dict[int, tuple[int, int]], width: int, k: int, metric: Metric) -> DataFrame:
    """(qid, id, score): the k best of each query in each cell."""

    def make(ids, vectors, queries):
        held = Held(ids, vectors, metric)
        for qi, qv in queries:
            yield from _found(held, qi, qv, k)

    return cells(x, q, sizes, width, make, "qid long, id long, score double")


def plain(df: DataFrame, *more) -> DataFrame:
    """(id, vector, ...) with vectors as they are, if they are arrays of float or double."""
    kind = dict(df.dtypes)["vector"]
    return df.select(F.col("id").cast("long"), F.col("vector") if kind in ("array<float>", "array<double>") else F.col("vector").cast("array<double>").alias("vector"), *more)


def alike(x: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with vectors of one type."""
    if dict(x.dtypes)["vector"] == dict(q.dtypes)["vector"]:
        return x, q
    return tuple(df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (x, q))


def ranked(candidates: DataFrame, k: int, metric: Metric, rank: str = "rank") -> DataFrame:
    """(qid, id, score, rank): the k best of each query among the candidates."""
    w = Window.partitionBy("qid").orderBy(F.col("score").asc() if metric.ascending else F.col("score").desc(), F.col("id"))
    return candidates.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, exclude: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) for corpus (id, vector) and queries (id, vector). ``exclude`` (id) holds tombstones."""
    metric = Metric.parse(metric)
    if k <= 0:
        raise InvalidRequest("k must be positive")
    if exclude is not None:
        from cairn.session import by_ids

        corpus = by_ids(corpus, exclude, "id", "left_anti")
    size, n = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.count("*")).first()
    if size > LIGHT_WORK // (8 * BLOCK):  # for fewer the corpus isn't counted
        rows = corpus.count()
        if rows * size > LIGHT_WORK or size > BROADCAST_NUMBERS:
            x, q = alike(plain(corpus, F.lit(0).cast("long").alias("by")), plain(queries, F.lit(0).cast("long").alias("by")))
            return ranked(cells_top_k(x, q, {0: (rows, n)}, -(-size // max(n, 1)), k, metric), k, metric)
    return ranked(block_top_k(pack(corpus, "x").crossJoin(F.broadcast(pack(queries, "q"))), k, metric), k, metric)


def one_query(spark, vector: list[float]) -> DataFrame:
    return spark.createDataFrame([(0, [float(x) for x in vector])], "id long, vector array<double>")


def pairwise(a: DataFrame, b: DataFrame, metric: Metric | str) -> DataFrame:
    """(qid, id, score): all pairs. The result is quadratic by definition; cells bound what a task holds and writes at once."""
    metric = Metric.parse(metric)
    n, size, rows = a.count(), b.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0], b.count()

    def make(ids, x, queries):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order].astype(np.float64)
        for qi, q in queries:
            step = max(1, 1_000_000 // len(ids))
            for i in range(0, len(qi), step):
                some = q[i : i + step].astype(np.float64)
                s = scores(metric, some, x)
                if metric is Metric.L2:  # what cancels is computed from the difference
                    r, c = np.nonzero(s * s < 1e-6 * ((some * some).sum(1)[:, None] + (x * x).sum(1)))
                    s[r, c] = np.sqrt(((some[r] - x[c]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[i : i + step], len(ids))), pa.array(np.tile(ids, len(some))), pa.array(np.round(s, 6).ravel() + 0.0)], schema=_FOUND)

    x, q = alike(plain(b, F.lit(0).cast("long").alias("by")), plain(a, F.lit(0).cast("long").alias("by")))
    return cells(x, q, {0: (rows, n)}, max(1, -(-size // max(rows, 1))), make, "qid long, id long, score double", PAIRS_WORK)
