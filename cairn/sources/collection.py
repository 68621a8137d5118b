"""Collections: immutable Parquet tables named by numbered JSON manifests.

``base`` holds segments of rows, ``gone`` the internal ids in them that no longer live, ``ops`` batches of operations since the last
checkpoint. A manifest names what is committed; a file that it doesn't name doesn't exist, so a torn write leaves no trace, and a
reader keeps the version with which it began. A commit creates the next numbered manifest, which only one writer can: another one that began from
the same version takes up the new one and applies its operation to it. The live view is the segments without what is gone or touched by the log,
and each id's last insert in the log.

A checkpoint appends: the log's rows become a segment, its rows are assigned to the known centroids, and their postings are added. Centroids are
learnt anew when the collection has grown to RETRAIN times the rows that they were learnt on; everything is rewritten when a quarter of the
rows is gone or segments are many. What a checkpoint retires is deleted by the next one, so that readers of the version before can finish.
"""

from __future__ import annotations

import collections
import contextlib
import datetime as dt
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn import model, timing
from cairn.functions import vector as V
from cairn.functions.text import query_tokens
from cairn.model import IndexType, Metric
from cairn.operators import bm25, filters, fusion, hnsw, ivf, knn
from cairn.session import by_ids, with_ordinals
from cairn.sources.files import Files

VERSION = 2
MAX_BATCH = 1000
#: Growth at which centroids are learnt anew; segments, and share of rows that are gone, at which all is rewritten; kept manifests; attempts of a writer.
RETRAIN, SEGMENTS, GONE, MANIFESTS, ATTEMPTS = 4, 16, 0.25, 10, 20
BASE = "internal_id long, id string, vector array<float>, metadata string, text string"
OPS = "seq long, op string, ts timestamp, " + BASE
_NAME = re.compile(r'[/\\:*?"<>|]')


def check_name(name: str) -> str:
    if not name or not name.strip() or name in (".", "..") or _NAME.search(name):
        raise model.InvalidRequest(f"not a name for a collection: {name!r}")
    return name


class Collection:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.m = manifest
        self.lock = threading.RLock()  # of this object; other writers are met at the commit
        self.counters = {"inserts": 0, "deletes": 0, "queries": 0}
        self.took: dict[str, collections.deque] = {}

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine", index_type: str = "flat", text_field: str | None = None, index_params: dict | None = None) -> "Collection":
        if not isinstance(dimension, int) or not 1 <= dimension <= 65_536:
            raise model.DimensionMismatch("the dimension lies between 1 and 65536")
        m = {
            "version": VERSION, "name": check_name(path.rstrip("/").rpartition("/")[2]), "dimension": dimension, "metric": Metric.parse(metric).value, "index_type": IndexType.parse(index_type).value, "text_field": text_field,
            "index_params": index_params or {}, "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "n": 0, "next_id": 0, "seq": 0, "base": [], "rows": 0, "gone": [], "gone_rows": 0, "live": 0,
            "ops": [], "index": None, "text": [], "streams": {}, "retired": [],
        }
        c = cls(spark, path, m)
        if not c.files.create(c._manifest(0), json.dumps(m, sort_keys=True, indent=1)):
            raise model.CollectionExists(path)
        return c

    @staticmethod
    def exists(files: Files, path: str) -> bool:
        return bool(files.children(f"{path.rstrip('/')}/versions"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Collection":
        c = cls(spark, path, {})
        c.refresh()
        return c

    def _manifest(self, n: int) -> str:
        return f"{self.path}/versions/{n:012d}.json"

    def refresh(self) -> None:
        """Take up the newest version."""
        names = self.files.children(f"{self.path}/versions")
        if not names:
            raise model.CorruptData(f"{self.path} has no manifest")
        p = f"{self.path}/versions/{names[-1]}"
        try:
            m = json.loads(self.files.read(p))
        except ValueError as e:
            raise model.CorruptData(f"{p}: {e}") from None
        if m.get("version") != VERSION:
            raise model.CorruptData(f"{p}: version {m.get('version')!r}")
        self.m = m

    def _commit(self, m: dict) -> None:
        m = m | {"n": self.m["n"] + 1}
        if not self.files.create(self._manifest(m["n"]), json.dumps(m, sort_keys=True, indent=1)):
            raise model.Conflict(f"another writer made version {m['n']} of {self.path}")
        self.m = m
        if m["n"] >= MANIFESTS:
            self.files.delete(self._manifest(m["n"] - MANIFESTS))

    def _attempt(self, work):
        """Apply an operation to the newest version, again if another writer commits first."""
        for _ in range(ATTEMPTS):
            try:
                return work()
            except model.Conflict:
                self.refresh()
        raise model.Conflict(f"{self.path} has too many writers")

    @contextlib.contextmanager
    def _timed(self, operation: str):
        began = time.perf_counter()
        yield
        self.took.setdefault(operation, collections.deque(maxlen=1000)).append(time.perf_counter() - began)

    @property
    def metric(self) -> Metric:
        return Metric(self.m["metric"])

    # -- writing

    def _records(self, items) -> DataFrame:
        """(pos, id, vector, metadata) of a frame, or of an iterable of dicts of 1 to 1000."""
        if isinstance(items, DataFrame):
            cols = items.columns
            meta = F.col("metadata") if "metadata" in cols and dict(items.dtypes)["metadata"] == "string" else F.to_json("metadata") if "metadata" in cols else F.lit(None)
            df = items.select(F.col("id").cast("string"), F.col("vector").cast("array<float>"), F.coalesce(meta.cast("string"), F.lit("{}")).alias("metadata"))
            return with_ordinals(df, [], "pos")
        rows = list(items)
        if not rows:
            raise model.InvalidRequest("an empty batch")
        if len(rows) > MAX_BATCH:
            raise model.BatchTooLarge(f"{len(rows)} items, {MAX_BATCH} at most")
        out = []
        for i, r in enumerate(rows):
            if "id" not in r or "vector" not in r or str(r["id"]) == "":
                raise model.InvalidRequest(f"item {i} needs an id and a vector")
            out.append((i, str(r["id"]), [float(x) for x in r["vector"]], json.dumps(r.get("metadata") or {})))
        return self.spark.createDataFrame(out, "pos long, id string, vector array<float>, metadata string")

    def _validate(self, rows: DataFrame) -> None:
        d = self.m["dimension"]
        bad = rows.agg(
            F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("ids"),
            F.count_if(F.coalesce(F.size("vector") != d, F.lit(True))).alias("sizes"),
            F.count_if(~F.coalesce(V.finite(F.col("vector"), d), F.lit(False))).alias("numbers"),
            F.count("*").alias("n"),
        ).first()
        if bad.n == 0 or bad.ids:
            raise model.InvalidRequest("an empty batch" if bad.n == 0 else f"{bad.ids} items without an id")
        if bad.sizes:
            raise model.DimensionMismatch(f"{bad.sizes} vectors haven't {d} numbers")
        if bad.numbers:
            raise model.InvalidRequest(f"{bad.numbers} vectors hold NaN or infinity")
        again = rows.groupBy("id").count().where("count > 1").limit(1).collect()
        if again:
            raise model.InvalidRequest(f"id {again[0].id!r} occurs twice in the batch")

    def _text(self, metadata):
        f = self.m["text_field"]
        if f is None:
            return F.lit(None).cast("string")
        v = F.try_variant_get(F.try_parse_json(metadata), "$['" + f.replace("'", "\\'") + "']", "variant")
        return F.when((F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != ""), F.try_variant_get(v, "$", "string"))

    def insert(self, items: DataFrame | Iterable[dict[str, Any]], upsert: bool = False, batch: tuple[str, int] | None = None) -> dict:
        """Insert all items or none. An existing id is an error, or with ``upsert`` replaced under a new internal id.

        A batch (stream, number) is applied once: repeating it, or an earlier one of its stream, changes nothing, whatever happened in between.
        """
        with self.lock, self._timed("insert"):
            rows = self._records(items)
            self._validate(rows)
            return self._attempt(lambda: self._insert(rows, upsert, batch))

    def _insert(self, rows: DataFrame, upsert: bool, batch: tuple[str, int] | None) -> dict:
        if batch is not None and batch[1] <= self.m["streams"].get(batch[0], -1):
            return {"inserted": 0, "duplicates_skipped": 0}
        known = self.live().join(rows.select("id"), "id", "left_semi")
        again = 0
        if upsert:
            again = known.count()
        elif clash := known.select("id").limit(1).collect():
            raise model.IdExists(clash[0].id)
        vector = V.normalize(F.col("vector")).cast("array<float>") if self.metric is Metric.COSINE else F.col("vector")
        out = rows.select(F.lit(self.m["seq"] + 1).cast("long").alias("seq"), F.lit("INSERT").alias("op"), F.current_timestamp().alias("ts"), (F.col("pos") + self.m["next_id"]).alias("internal_id"), "id", vector.alias("vector"), "metadata", self._text(F.col("metadata")).alias("text"))
        n = self._append(out, again, {} if batch is None else {batch[0]: batch[1]})
        self.counters["inserts"] += n
        return {"inserted": n, "duplicates_skipped": 0}

    def _append(self, ops: DataFrame, ended: int | None, streams: dict) -> int:
        """Commit a batch of operations that ends ``ended`` live rows (None: as many as it has)."""
        name = f"ops/{uuid.uuid4().hex}"
        ops.write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(OPS).parquet(f"{self.path}/{name}").agg(F.count("*").alias("n"), F.count_if(F.col("op") == "INSERT").alias("i")).first()
        new = {"ops": [*self.m["ops"], {"path": name, "rows": n.n}], "seq": self.m["seq"] + 1, "next_id": self.m["next_id"] + n.i, "live": self.m["live"] + n.i - (n.n if ended is None else ended), "streams": self.m["streams"] | streams}
        try:
            self._commit(self.m | new)
        except model.Conflict:
            self.files.delete(f"{self.path}/{name}")
            raise
        return n.n

    def delete(self, id: str) -> None:
        def work() -> None:
            row = self.live().where(F.col("id") == str(id)).limit(1).collect()
            if not row:
                raise model.IdNotFound(str(id))
            op = self.spark.createDataFrame([(self.m["seq"] + 1, "DELETE", dt.datetime.now(dt.timezone.utc), row[0].internal_id, str(id), None, None, None)], OPS)
            self._append(op, 1, {})

        with self.lock, self._timed("delete"):
            self._attempt(work)
            self.counters["deletes"] += 1

    def delete_all(self, ids: DataFrame) -> int:
        """Delete the rows of these ids (first column) in one operation; unknown ids don't matter. The number of rows deleted."""

        def work() -> int:
            known = by_ids(self.live(), ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")
            none = [F.lit(None).cast(t).alias(c) for c, t in (("vector", "array<float>"), ("metadata", "string"), ("text", "string"))]
            ops = known.select(F.lit(self.m["seq"] + 1).cast("long").alias("seq"), F.lit("DELETE").alias("op"), F.current_timestamp().alias("ts"), "internal_id", "id", *none)
            return self._append(ops, None, {})

        with self.lock, self._timed("delete"):
            n = self._attempt(work)
            self.counters["deletes"] += n
            return n

    # -- reading

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _gone(self) -> DataFrame:
        return self._read("internal_id long", self.m["gone"])

    def base(self) -> DataFrame:
        """The live rows of the last checkpoint."""
        rows = self._read(BASE, self.m["base"])
        return by_ids(rows, self._gone(), "internal_id", "left_anti") if self.m["gone"] else rows

    def operations(self) -> DataFrame:
        """The log since the last checkpoint."""
        return self._read(OPS, [o["path"] for o in self.m["ops"]])

    def _last(self) -> DataFrame:
        if len(self.m["ops"]) == 1:  # a batch has an id once
            return self.operations()
        w = Window.partitionBy("id").orderBy(F.desc("seq"))
        return self.operations().withColumn("__r", F.row_number().over(w)).where("__r = 1")

    def _fresh(self) -> DataFrame:
        """Rows that the log has put in."""
        return self._last().where("op = 'INSERT'").select("internal_id", "id", "vector", "metadata", "text")

    def live(self) -> DataFrame:
        if not self.m["ops"]:
            return self.base()
        new = self._fresh()
        return by_ids(self.base(), self._last().select("id"), "id", "left_anti").select(new.columns).union(new)

    def _dead(self) -> DataFrame | None:
        """Internal ids of the segments' rows that no longer live."""
        if not self.m["ops"]:
            return self._gone() if self.m["gone"] else None
        ended = by_ids(self.base(), self._last().select("id"), "id", "left_semi").select("internal_id")
        return self._gone().union(ended) if self.m["gone"] else ended

    def get(self, id: str) -> dict:
        rows = self.live().where(F.col("id") == str(id)).limit(1).collect()
        if not rows:
            raise model.IdNotFound(str(id))
        return {"id": rows[0].id, "vector": list(rows[0].vector), "metadata": json.loads(rows[0].metadata)}

    def gather(self, ids: list[str]) -> list[dict]:
        """The rows of up to MAX_BATCH ids, in the order asked for; an unknown id is an error."""
        if len(ids) > MAX_BATCH:
            raise model.BatchTooLarge(f"{len(ids)} ids, {MAX_BATCH} at most")
        rows = {r.id: r for r in self.live().where(F.col("id").isin([str(i) for i in ids])).collect()}
        for i in ids:
            if str(i) not in rows:
                raise model.IdNotFound(str(i))
        return [{"id": rows[str(i)].id, "vector": list(rows[str(i)].vector), "metadata": json.loads(rows[str(i)].metadata)} for i in ids]

    def contains(self, id: str) -> bool:
        return bool(self.live().where(F.col("id") == str(id)).select("id").limit(1).collect())

    def known(self, ids: DataFrame) -> DataFrame:
        """Those of the ids (first column) that the collection has."""
        return by_ids(self.live().select("id"), ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")

    def iter_ids(self) -> DataFrame:
        return self.live().select("id")

    def _corpus(self, live: DataFrame) -> DataFrame:
        return live.select(F.col("internal_id").alias("id"), "vector")

    def _queries(self, vectors: list[list[float]] | DataFrame) -> DataFrame:
        if isinstance(vectors, DataFrame):
            return vectors
        for v in vectors:
            if len(v) != self.m["dimension"]:
                raise model.DimensionMismatch(f"{len(v)} numbers, not {self.m['dimension']}")
            if not all(math.isfinite(x) for x in v):
                raise model.InvalidRequest("the query holds NaN or infinity")
        return self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")

    def _candidates(self, live: DataFrame, queries: DataFrame, k: int, params: dict | None, exclude: DataFrame | None = None) -> DataFrame:
        """``exclude``: internal ids that don't count, beside what is dead."""
        params, idx = params or {}, self.m["index"]
        x = self._corpus(live)
        if exclude is not None:
            x = by_ids(x, exclude, "id", "left_anti")
        if idx is None or self.m["index_type"] == "flat":
            return knn.knn(x, queries, k, self.metric)
        dead = self._dead()
        dead = dead.select(F.col("internal_id").alias("id")) if dead is not None else None
        fresh = self._corpus(self._fresh()) if self.m["ops"] else None
        if exclude is not None:
            dead = exclude if dead is None else dead.union(exclude).distinct()
            fresh = by_ids(fresh, exclude, "id", "left_anti") if fresh is not None else None
        if self.m["index_type"] == "ivf":
            lists = ivf.read_lists(self.spark, [f"{self.path}/{p}" for p in idx["lists"]])
            return ivf.search(lists, self.spark.read.parquet(f"{self.path}/{idx['centroids']}"), queries, k, params.get("nprobe"), self.metric, fresh, dead)
        found = None
        for p in idx["shards"]:
            part = hnsw.search(self.spark.read.parquet(f"{self.path}/{p}"), queries, k, self.metric, params.get("ef_search"), dead).drop("rank")
            found = part if found is None else found.union(part)
        if fresh is not None:
            found = found.union(knn.knn(fresh, queries, k, self.metric).drop("rank"))
        return knn.ranked(found, k, self.metric)

    @staticmethod
    def _hydrate(hits: DataFrame, live: DataFrame) -> DataFrame:
        return hits.join(live.select(F.col("internal_id").alias("id"), F.col("id").alias("ext"), "metadata"), "id").withColumnsRenamed({"id": "internal_id"}).withColumnsRenamed({"ext": "id"})

    def search_batch(self, vectors: list[list[float]] | DataFrame, k: int = 10, filter: dict | None = None, params: dict | None = None, exclude: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, internal_id, score, metadata); a filter is applied after retrieval, so fewer than k rows may remain.

        ``exclude``: ids (first column) that aren't searched.
        """
        if k <= 0:
            raise model.InvalidRequest("k must be positive")
        self.counters["queries"] += 1
        live = self.live()
        if exclude is not None:
            ids = exclude.select(F.col(exclude.columns[0]).cast("string").alias("id")).distinct()
            exclude = by_ids(live, ids, "id", "left_semi").select(F.col("internal_id").alias("id"))
        hits = self._hydrate(self._candidates(live, self._queries(vectors), model.fetch_size(k, bool(filter)), params, exclude), live)
        w = Window.partitionBy("qid").orderBy("rank")
        return hits.where(filters.on_json(F.col("metadata"), filter)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "internal_id", "score", "metadata")

    def search(self, vector: list[float], k: int = 10, filter: dict | None = None, params: dict | None = None) -> list[dict]:
        with self._timed("search"):
            return self._hits(self.search_batch([vector], k, filter, params))

    @staticmethod
    def _hits(df: DataFrame) -> list[dict]:
        return [{"id": r.id, "internal_id": r.internal_id, "score": r.score, "metadata": json.loads(r.metadata)} | ({"ranks": dict(r.ranks)} if "ranks" in df.columns else {}) for r in df.orderBy("rank").collect()]

    def _indexed(self, live: DataFrame) -> DataFrame:
        return bm25.indexed(live.select(F.col("internal_id").alias("id"), "text"))

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """Postings (term, id, tf, dl, bucket) of the live rows, and one row (n_docs, total_len, avgdl): the stored ones, less what is dead, and the log's."""
        if self.m["text_field"] is None:
            raise model.NoTextField(self.m["name"])
        cols, found, sizes = ["term", "id", "tf", "dl", "bucket"], None, None
        for p in self.m["text"]:
            x, y = bm25.read_postings(self.spark, f"{self.path}/{p}").select(cols), bm25.read_lengths(self.spark, f"{self.path}/{p}")
            found, sizes = (x, y) if found is None else (found.union(x), sizes.union(y))
        dead = self._dead()
        if dead is not None and found is not None:
            dead = dead.select(F.col("internal_id").alias("id"))
            found, sizes = by_ids(found, dead, "id", "left_anti"), by_ids(sizes, dead, "id", "left_anti")
        if self.m["ops"] or found is None:
            new = self._indexed(self._fresh())
            x, y = bm25.postings(new).withColumn("bucket", bm25.bucket(F.col("term"), bm25.BUCKETS)).select(cols), bm25.lengths(new)
            found, sizes = (x, y) if found is None else (found.select(cols).union(x), sizes.select("id", "dl").union(y))
        return found, bm25.summed(sizes)

    def search_text_frame(self, text: str, k: int = 10, filter: dict | None = None) -> DataFrame:
        if k <= 0:
            raise model.InvalidRequest("k must be positive")
        self.counters["queries"] += 1
        live = self.live()
        hits = self._hydrate(bm25.search_postings(*self.postings(), text, model.fetch_size(k, bool(filter))), live).where(filters.on_json(F.col("metadata"), filter))
        return bm25.numbered(hits.drop("rank").withColumn("o", F.lit(0)).orderBy(F.desc("score"), "internal_id").limit(k), [F.desc("score"), F.col("internal_id")]).drop("o")

    def search_text_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, rank, id, internal_id, score, metadata) of the queries (qid, text)."""
        found, s = self.postings()
        return self._hydrate(bm25.search_batch(found, s, queries, k), self.live()).select("qid", "rank", "id", "internal_id", "score", "metadata")

    def search_text(self, text: str, k: int = 10, filter: dict | None = None) -> list[dict]:
        with self._timed("search_text"):
            return self._hits(self.search_text_frame(text, k, filter))

    def search_hybrid_frame(self, vector: list[float], text: str, k: int = 10, filter: dict | None = None, params: dict | None = None) -> DataFrame:
        if k <= 0:
            raise model.InvalidRequest("k must be positive")
        params = dict(params or {})
        rrf_k, dense_n, sparse_n = params.pop("rrf_k", fusion.K), params.pop("dense_candidates", 10 * k), params.pop("sparse_candidates", 10 * k)
        self.counters["queries"] += 1
        live = self.live()
        dense = self._candidates(live, self._queries([vector]), dense_n, params).select("id", "rank")
        sparse = bm25.search_postings(*self.postings(), text, sparse_n).select("id", "rank")
        hits = self._hydrate(fusion.rrf({"dense": dense, "sparse": sparse}, rrf_k), live).where(filters.on_json(F.col("metadata"), filter))
        return bm25.numbered(hits.orderBy("rank").limit(k), [F.col("rank")], "rank")

    def search_hybrid(self, vector: list[float], text: str, k: int = 10, filter: dict | None = None, params: dict | None = None) -> list[dict]:
        with self._timed("search_hybrid"):
            return self._hits(self.search_hybrid_frame(vector, text, k, filter, params))

    def explain(self, text: str, id: str) -> DataFrame:
        live = self.live()
        row = live.where(F.col("id") == str(id)).limit(1).collect()
        if not row:
            raise model.IdNotFound(str(id))
        found, s = self.postings()
        terms = sorted(set(query_tokens(text)))
        q = self.spark.createDataFrame([(t, 1) for t in terms], "term string, qtf long")
        return bm25.explained(bm25.weigh(bm25.of_terms(found, terms), s, F.broadcast(q)), text, row[0].internal_id)

    # -- maintenance

    def checkpoint(self) -> None:
        """The log becomes a segment of the base, and part of the indexes; what it ended is noted as gone. The log is empty then."""
        with self.lock, self._timed("checkpoint"):
            self._attempt(self._checkpoint)

    def _checkpoint(self) -> None:
        if not self.m["ops"]:
            return
        ended = f"gone/{uuid.uuid4().hex}"
        by_ids(self.base(), self._last().select("id"), "id", "left_semi").select("internal_id").write.parquet(f"{self.path}/{ended}")
        lost = self._read("internal_id long", [ended]).count()
        gone, gone_rows = ([*self.m["gone"], ended], self.m["gone_rows"] + lost) if lost else (self.m["gone"], self.m["gone_rows"])
        if gone_rows > GONE * (self.m["rows"] or 1) or len(self.m["base"]) >= SEGMENTS:
            self._rebase(self.live().select("internal_id", "id", "vector", "metadata", "text"), self.m["next_id"])
            return
        name = f"base/{uuid.uuid4().hex}"
        self._fresh().write.parquet(f"{self.path}/{name}")
        rows = self._read(BASE, [name])
        n = rows.count()
        m = self.m | {"ops": [], "gone": gone, "gone_rows": gone_rows, "retired": [o["path"] for o in self.m["ops"]]}
        if n:
            m |= {"base": [*self.m["base"], name], "rows": self.m["rows"] + n}
            m["index"], m["text"] = self._grown(m, rows, n), [*self.m["text"], *self._text_index(rows)]
            if m["index"] != self.m["index"] and self.m["index"]:
                m["retired"] += [p for p in _paths(self.m["index"]) if p not in _paths(m["index"])]
        before = self.m["retired"]
        self._commit(m)
        self._discard(before)

    def _rebase(self, rows: DataFrame, next_id: int) -> None:
        """Everything written anew from the rows."""
        name = f"base/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        made = self._read(BASE, [name])
        n = made.count()
        old = [*self.m["base"], *self.m["gone"], *(o["path"] for o in self.m["ops"]), *self.m["text"], *_paths(self.m["index"])]
        m = self.m | {"base": [name], "rows": n, "gone": [], "gone_rows": 0, "live": n, "ops": [], "next_id": next_id, "index": None, "text": [], "retired": old}
        m["index"], m["text"] = self._grown(m, made, n), self._text_index(made)
        before = self.m["retired"]
        self._commit(m)
        self._discard(before)

    def _discard(self, paths: list[str]) -> None:
        for p in paths:
            self.files.delete(f"{self.path}/{p}")

    def _text_index(self, rows: DataFrame) -> list[str]:
        if self.m["text_field"] is None:
            return []
        name = f"text/{uuid.uuid4().hex}"
        bm25.write_index(rows.select(F.col("internal_id").alias("id"), "text"), f"{self.path}/{name}")
        return [name]

    def _grown(self, m: dict, rows: DataFrame, n: int) -> dict | None:
        """The index of manifest ``m`` with a segment of n rows more."""
        return _GROW[m["index_type"]](self, m, rows, n, f"index/{uuid.uuid4().hex}")

    def _grow_hnsw(self, m: dict, rows: DataFrame, n: int, name: str) -> dict | None:
        index, p = m["index"], m["index_params"]
        if n == 0:
            return index
        hnsw.build(self._corpus(rows), self.metric, p.get("M", hnsw.M), p.get("ef_construction", hnsw.EF_CONSTRUCTION), p.get("seed", hnsw.SEED)).write.parquet(f"{self.path}/{name}/shards")
        return {"shards": [*(index or {"shards": []})["shards"], f"{name}/shards"]}

    def _grow_ivf(self, m: dict, rows: DataFrame, n: int, name: str) -> dict | None:
        index, p = m["index"], m["index_params"]
        nlist, total = p.get("nlist", ivf.NLIST), m["rows"] - m["gone_rows"]
        if index is None or total >= RETRAIN * index["trained"]:
            if total < nlist:
                return None
            every = self._read(BASE, m["base"])
            x = self._corpus(by_ids(every, self._read("internal_id long", m["gone"]), "internal_id", "left_anti") if m["gone"] else every)
            c = ivf.train(x, nlist, self.metric, p.get("max_iter", ivf.ITERATIONS), p.get("train_sample", ivf.SAMPLE), p.get("seed", ivf.SEED))
            c.write.parquet(f"{self.path}/{name}/centroids")
            index = {"centroids": f"{name}/centroids", "lists": [], "trained": total}
        else:
            x = self._corpus(rows)
        ivf.write_lists(x, self.spark.read.parquet(f"{self.path}/{index['centroids']}"), self.metric, f"{self.path}/{name}/lists")
        return index | {"lists": [*index["lists"], f"{name}/lists"]}

    def optimize(self) -> dict:
        """Drop what is deleted, renumber the rest from 0 in the old order, rebuild the indexes."""

        def work() -> dict:
            began, before = time.time(), self.m["next_id"]
            n = self.live().count()
            rows = with_ordinals(self.live().withColumnRenamed("internal_id", "old"), ["old"], "internal_id")
            self._rebase(rows.select("internal_id", "id", "vector", "metadata", "text"), n)
            return {"compacted": before - n, "num_vectors": n, "took_ms": round((time.time() - began) * 1000, 1)}

        with self.lock, self._timed("optimize"):
            return self._attempt(work)

    def snapshot(self) -> str:
        """A copy of the checkpointed state that opens as a collection of its own."""
        self.checkpoint()
        with self.lock:
            target = f"{self.path}/snapshots/{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"
            for part in (*self.m["base"], *self.m["gone"], *self.m["text"], *_paths(self.m["index"])):
                self.files.copy(f"{self.path}/{part}", f"{target}/{part}")
            self.files.create(f"{target}/versions/{0:012d}.json", json.dumps(self.m | {"n": 0, "retired": []}, sort_keys=True))
            return target

    def close(self) -> None:
        """Checkpoint; the object isn't used after that."""
        self.checkpoint()

    def stats(self) -> dict:
        out = {k: self.m[k] for k in ("name", "dimension", "metric", "index_type", "text_field", "created_at")} | {
            "num_vectors": self.m["live"], "num_deleted": self.m["next_id"] - self.m["live"], "log": {"batches": len(self.m["ops"]), "rows": sum(o["rows"] for o in self.m["ops"])}, "version": self.m["n"], "segments": len(self.m["base"]),
            "disk_bytes": self.files.size(self.path), "operations": dict(self.counters), "latency": self.latencies(), "index": {k: len(v) if isinstance(v, list) else v for k, v in (self.m["index"] or {}).items()},
        }
        if self.m["text_field"]:
            found, s = self.postings()
            s, v = s.first(), found.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("n")).first()
            out["bm25"] = {"num_docs": s.n_docs, "avgdl": s.avgdl, "vocabulary_size": v.terms, "num_postings": v.n}
        return out

    def latencies(self) -> dict:
        """Nearest-rank percentiles of the last thousand calls of each operation, in milliseconds."""
        return {name: timing.summary(list(t)) for name, t in self.took.items()}

    def drop(self) -> None:
        self.files.delete(self.path)


#: What makes an index grow by a segment, by its type.
_GROW = {"flat": lambda *_: None, "ivf": Collection._grow_ivf, "hnsw": Collection._grow_hnsw}


def _paths(index: dict | None) -> list[str]:
    """Folders of an index."""
    return [p for v in (index or {}).values() for p in (v if isinstance(v, list) else [v]) if isinstance(p, str)]


class CollectionManager:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.open: dict[str, Collection] = {}
        self.failed: dict[str, str] = {}

    def load_all(self) -> list[str]:
        for name in self.files.children(self.root):
            if name not in self.open and Collection.exists(self.files, f"{self.root}/{name}"):
                try:
                    self.open[name] = Collection.open(self.spark, f"{self.root}/{name}")
                except model.EngineError as e:
                    self.failed[name] = str(e)
        return sorted(self.open)

    def create(self, name: str, dimension: int, **options) -> Collection:
        check_name(name)
        if self.exists(name):
            raise model.CollectionExists(name)
        self.open[name] = Collection.create(self.spark, f"{self.root}/{name}", dimension, **options)
        return self.open[name]

    def get(self, name: str) -> Collection:
        if name not in self.open:
            if not Collection.exists(self.files, f"{self.root}/{check_name(name)}"):
                raise model.CollectionNotFound(name)
            self.open[name] = Collection.open(self.spark, f"{self.root}/{name}")
        return self.open[name]

    def exists(self, name: str) -> bool:
        return name in self.open or Collection.exists(self.files, f"{self.root}/{check_name(name)}")

    def drop(self, name: str) -> None:
        self.get(name).drop()
        self.open.pop(name, None)

    def list(self) -> list[dict]:
        return [{k: s[k] for k in ("name", "dimension", "metric", "index_type", "num_vectors", "num_deleted")} for s in (self.get(n).stats() for n in self.load_all())]

    def checkpoint_all(self) -> None:
        for c in self.open.values():
            c.checkpoint()

    def close(self) -> None:
        self.checkpoint_all()
        self.open.clear()

    def metrics(self) -> str:
        """Gauges and counters as text for a scraper."""
        quote = lambda s: s.replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")
        lines = []
        for n, c in sorted(self.open.items()):  # from the manifests; no job runs
            lines += [f'cairn_{k}{{collection="{quote(n)}"}} {v}' for k, v in (("vectors", c.m["live"]), ("deleted", c.m["next_id"] - c.m["live"]), ("log_rows", sum(o["rows"] for o in c.m["ops"])), ("segments", len(c.m["base"])), ("version", c.m["n"]))]
            lines += [f'cairn_operations_total{{collection="{quote(n)}",operation="{k}"}} {v}' for k, v in c.counters.items()]
            lines += [f'cairn_latency_ms{{collection="{quote(n)}",operation="{k}",quantile="{q}"}} {v[q]}' for k, v in c.latencies().items() for q in ("p50", "p95", "p99")]
        return "\n".join(lines) + "\n"
