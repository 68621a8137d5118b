"""The engine's queries over the test tables, and DuckDB SQL that gives the same rows.

The collection C is ``embeddings`` left joined with ``documents`` on the id; its metadata are label, lang, source and n_chars.
Mutations are: insert all, delete ids that end in 3, upsert ids that end in 7 with the negated vector.

In queries of many vectors every row of the table is a query, in their SQL too; searches for one vector take that of row 0. Collections and
stored indexes are made once in an application for each folder of tables, as a service would have them, and asked after that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import vector as V
from cairn.functions.text import tokens
from cairn.model import fetch_size
from cairn.operators import bm25, evaluate, filters, fusion, hnsw, ivf, knn
from cairn.session import by_ids, stored

K, TEXT, DEPTH = 10, "the license of stupid trash and des", 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def scaled(spark, d) -> DataFrame:
    """Vectors that aren't of unit length."""
    return vectors(spark, d).select("id", F.transform(V.doubles(F.col("vector")), lambda x: x * (1 + F.col("label"))).alias("vector"), "label")


def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def collection(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    v = vectors(spark, d)
    return v.join(by_ids(docs, v.select("id"), "id", "left_semi"), "id", "left")


def first(df: DataFrame) -> DataFrame:
    """The one query vector of single searches."""
    return df.where("id = 0").select("id", "vector")


def asking(v: DataFrame) -> DataFrame:
    return v.select("id", "vector")


_made: dict[tuple, object] = {}


def prepared(spark: SparkSession, d: str, name: str, make):
    """What ``make`` gives, made once in an application for the folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _hits(df: DataFrame, one: bool = True) -> DataFrame:
    return df.select(*([] if one else ["qid"]), F.col("id").alias("internal_id"), "score", "rank")


# -- dense


def normalize(spark, d):
    v = scaled(spark, d).select("id", F.posexplode(V.normalize(F.col("vector"))).alias("pos", "x"))
    return v.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def pairwise_distance(spark, d):
    v = scaled(spark, d)
    return knn.pairwise(asking(v), asking(v), "l2").select("qid", F.col("id").alias("internal_id"), F.col("score").alias("distance"))


def _flat(metric):
    def query(spark, d):
        v = scaled(spark, d)
        return _hits(knn.knn(v, first(v), K, metric))

    return query


def knn_batch(spark, d):
    v = vectors(spark, d)
    return _hits(knn.knn(v, v, K, "cosine"), one=False)


_SCORE = {
    "cosine": "round(list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-12) * greatest(sqrt(list_inner_product({b}, {b})), 1e-12)), 6)",
    "dot": "round(list_inner_product({a}, {b}), 6)",
    "l2": "round(sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))), 6)",
}
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
_S = "v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS vector, label FROM embeddings)"


def _score(metric, a="v.vector", b="q.vector"):
    return _SCORE[metric].format(a=a, b=b)


def _knn_sql(metric, source=_V, where="TRUE", k=K, queries="id = 0", columns="id AS internal_id, score, rank"):
    order = "score" if metric == "l2" else "score DESC"
    return f"""WITH {source}, q AS (SELECT id AS qid, vector FROM v WHERE {queries}),
s AS (SELECT qid, v.id, {_score(metric)} + 0.0 AS score FROM v, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM s)
SELECT {columns} FROM r WHERE rank <= {k}"""


# -- filters

_MD = "c AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS vector, e.label, d.text, d.lang, d.source, d.n_chars FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"


def made_collection(spark, d, **options):
    """A checkpointed collection of the whole table C, with its metadata as JSON."""
    from cairn.session import shared_dir
    from cairn.sources.collection import Collection

    def make():
        c = Collection.create(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", 64, text_field="text", **options)
        meta = F.to_json(F.struct("label", "lang", "source", "n_chars", "text"))
        c.insert(collection(spark, d).orderBy("id").select(F.col("id").cast("string").alias("id"), "vector", meta.alias("metadata")))
        c.checkpoint()
        return c

    return prepared(spark, d, f"collection {sorted(options.items())}", make)


def _of(metadata: str, kind: str):
    return F.get_json_object("metadata", f"$.{metadata}").cast(kind).alias(metadata)


def _filter(criteria):
    def query(spark, d):
        rows = made_collection(spark, d, metric="l2").live().where(filters.on_json(F.col("metadata"), criteria))
        return rows.select(F.col("id").cast("long").alias("internal_id"), _of("label", "int"), _of("lang", "string"))

    return query


def _filter_sql(where):
    return f"WITH {_MD} SELECT id AS internal_id, label, lang FROM c WHERE {where}"


def knn_post_filter(spark, d):
    c = collection(spark, d)
    hits = knn.knn(c, first(c), fetch_size(K, True), "cosine")
    kept = hits.join(c.select("id", "label", "lang"), "id").where(filters.on_columns({"lang": ["de", "fr"]}))
    return kept.orderBy("rank").limit(K).select(F.col("id").alias("internal_id"), "score")


def knn_pre_filter(spark, d):
    c = collection(spark, d)
    return _hits(knn.knn(c.where(filters.on_columns({"lang": ["de", "fr"]})), first(c), K, "cosine"))


# -- mutations


def dead_ids(spark, d) -> DataFrame:
    return vectors(spark, d).where("id % 10 = 3").select("id")


def knn_tombstones(spark, d):
    v = vectors(spark, d)
    return _hits(knn.knn(v, first(v), K, "cosine", exclude=dead_ids(spark, d)))


def mutated(spark, d):
    """A collection after: insert all, delete the ids that end in 3, upsert those that end in 7 with the negated vector."""
    from cairn.session import shared_dir
    from cairn.sources.collection import Collection

    def make():
        v = vectors(spark, d).select(F.col("id"), F.col("vector")).orderBy("id")
        c = Collection.create(spark, f"{shared_dir(spark)}/mutated-{uuid.uuid4().hex}", 64, metric="l2")
        named = lambda df: df.select(F.col("id").cast("string").alias("id"), "vector")
        c.insert(named(v))
        c.checkpoint()
        c.delete_all(dead_ids(spark, d))
        c.insert(named(v.where("id % 10 = 7").withColumn("vector", F.transform("vector", lambda x: -x))), upsert=True)
        return c

    return prepared(spark, d, "mutated", make)


def upsert_latest(spark, d):
    return mutated(spark, d).live().select("id", "internal_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("x0"))


def delete_view(spark, d):
    v = vectors(spark, d)
    return by_ids(v, dead_ids(spark, d), "id", "left_anti").select(F.col("id").alias("internal_id"), "label")


def optimize_renumber(spark, d):
    from cairn.sources.collection import Collection

    c = Collection.open(spark, mutated(spark, d).snapshot())
    before = c.live().select("id", F.col("internal_id").alias("old_internal_id"))
    c.optimize()
    return before.join(c.live().select("id", "internal_id"), "id").select("id", "old_internal_id", "internal_id")


def insert_conflicts(spark, d):
    batch = vectors(spark, d).select((F.col("id") * 3).cast("string").alias("id"))
    return mutated(spark, d).known(batch).select(F.col("id").cast("long").alias("id"))


def collection_counts(spark, d):
    s = mutated(spark, d).stats()
    return spark.createDataFrame([(s["num_vectors"], s["num_deleted"])], "num_vectors long, num_deleted long")


def point_lookup(spark, d):
    r = made_collection(spark, d, metric="l2").get("42")
    m = r["metadata"]
    return spark.createDataFrame([(r["id"], m.get("label"), m.get("lang"), m.get("source"), m.get("n_chars"), round(r["vector"][0], 6))], "id string, label int, lang string, source string, n_chars long, x0 double")


def contains(spark, d):
    c = mutated(spark, d)
    return spark.createDataFrame([(i, c.contains(i)) for i in ("42", "43", "nothing")], "id string, found boolean")


def live_ids(spark, d):
    return mutated(spark, d).iter_ids()


def collection_summary(spark, d):
    s = mutated(spark, d).stats()
    return spark.createDataFrame([(s["dimension"], s["metric"], s["num_vectors"], s["num_deleted"])], "dimension long, metric string, num_vectors long, num_deleted long")


_LOG = """e AS (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings),
live AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS internal_id, vector[1] AS x0 FROM e WHERE vec_id % 10 NOT IN (3, 7)
 UNION ALL SELECT CAST(vec_id AS VARCHAR), (SELECT count(*) FROM e) + row_number() OVER (ORDER BY vec_id) - 1, -vector[1] FROM e WHERE vec_id % 10 = 7)"""
_COUNTS = "(SELECT count(*) FROM live) AS num_vectors, (SELECT count(*) FROM e) + (SELECT count(*) FROM e WHERE vec_id % 10 = 7) - (SELECT count(*) FROM live) AS num_deleted"


# -- text


def tokenize(spark, d):
    t = texts(spark, d).select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return t.select("id", F.col("pos").cast("long").alias("pos"), "term")


def _idx(spark, d):
    return bm25.indexed(texts(spark, d))


def bm25_tf(spark, d):
    return bm25.postings(_idx(spark, d)).select("term", "id", "tf")


def bm25_df_idf(spark, d):
    return bm25.term_stats(_idx(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_stats(spark, d):
    return bm25.stats(_idx(spark, d)).select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


def bm25_vocab(spark, d):
    return bm25.vocabulary(_idx(spark, d))


def text_index(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored postings of the documents, and their lengths."""
    from cairn.session import shared_dir

    def make():
        path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        bm25.write_index(texts(spark, d), path)
        return path

    path = prepared(spark, d, "postings", make)
    return bm25.read_postings(spark, path), bm25.read_lengths(spark, path)


def _bm25(text, dead=False):
    def query(spark, d):
        found, sizes = text_index(spark, d)
        if dead:
            gone = texts(spark, d).where("id % 10 = 3").select("id")
            found, sizes = by_ids(found, gone, "id", "left_anti"), by_ids(sizes, gone, "id", "left_anti")
        return _hits(bm25.search_postings(found, bm25.summed(sizes), text, K))

    return query


def bm25_batch(spark, d):
    """The first words of every benchmark passage, searched for in all documents."""
    found, sizes = text_index(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(tokens(F.col("text")), 1, 4), " ").alias("text"))
    return bm25.search_batch(found.select("term", "id", "tf", "dl"), bm25.summed(sizes), q, K).select("qid", F.col("id").alias("internal_id"), "score", "rank")


def bm25_explain(spark, d):
    i = _idx(spark, d)
    return bm25.explain(i, TEXT + " zzzunknown", 1).select("term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


_TOK = "t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM documents WHERE text IS NOT NULL AND text <> '')"
_POST = """st AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) AS total_len, coalesce(sum(len(tokens)) / count(*)::DOUBLE, 0) AS avgdl FROM t),
tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(((SELECT n_docs FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM tf GROUP BY term)"""


def _bm25_cte(text, tok=_TOK):
    words = ", ".join(f"('{w}')" for w in text.split())
    return f"""{tok}, {_POST}, qt AS (SELECT term, count(*) AS qtf FROM (VALUES {words}) w(term) GROUP BY term),
co AS (SELECT tf.id, tf.term, tf.tf, df.df, df.idf, qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t.tokens) / avgdl)) AS c
 FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN t ON t.id = tf.id, st)"""


def _bm25_rank(k):
    return f"bm AS (SELECT id, round(sum(c), 6) AS score, row_number() OVER (ORDER BY round(sum(c), 6) DESC, id) AS rank FROM co GROUP BY id QUALIFY rank <= {k})"


def _explain_sql():
    """Only the query's terms are counted, and only document 1 is weighed."""
    words = ", ".join(f"('{w}')" for w in (TEXT + " zzzunknown").split())
    return f"""WITH {_TOK}, st AS (SELECT count(*) AS n_docs, sum(len(tokens)) / count(*)::DOUBLE AS avgdl FROM t),
qt AS (SELECT term, count(*) AS qtf FROM (VALUES {words}) w(term) GROUP BY term),
hit AS (SELECT qt.term, t.id, len(list_filter(t.tokens, lambda x: x = qt.term)) AS tf FROM t, qt),
df AS (SELECT term, count(*) AS df, ln(((SELECT n_docs FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM hit WHERE tf > 0 GROUP BY term),
co AS (SELECT hit.term, tf, qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t.tokens) / avgdl)) AS c FROM hit JOIN qt USING (term) JOIN df USING (term) JOIN t ON t.id = hit.id, st WHERE hit.id = 1 AND tf > 0)
SELECT qt.term, coalesce(co.tf, 0) AS tf, coalesce(df.df, 0) AS df, round(coalesce(df.idf, 0), 6) AS idf, round(coalesce(co.c, 0), 6) AS contribution FROM qt LEFT JOIN df USING (term) LEFT JOIN co USING (term)"""


# -- fusion


def _rankings(spark, d, depth=DEPTH):
    c = collection(spark, d)
    dense = knn.knn(c, first(c), depth, "cosine").select("id", "rank")
    found, stats = made_collection(spark, d, metric="l2").postings()
    return {"dense": dense, "sparse": bm25.search_postings(found, stats, TEXT, depth).select("id", "rank")}


def _fused(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("internal_id"), "score", F.col("ranks")["dense"].alias("dense_rank"), F.col("ranks")["sparse"].alias("sparse_rank"), "rank")


def rrf_fuse(spark, d):
    return _fused(fusion.rrf(_rankings(spark, d)))


def weighted_rrf(spark, d):
    return _fused(fusion.rrf(_rankings(spark, d), top_k=K, weights={"dense": 0.7, "sparse": 0.3}))


def hybrid_search(spark, d):
    return _fused(fusion.rrf(_rankings(spark, d, 10 * K), top_k=K))


def hybrid_filter(spark, d):
    c = collection(spark, d).select("id", "lang")
    kept = fusion.rrf(_rankings(spark, d, 10 * K)).join(c, "id").where(filters.on_columns({"lang": "en"}))
    return kept.orderBy("rank").limit(K).select(F.col("id").alias("internal_id"), "score")


_CTOK = "t AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM c WHERE text IS NOT NULL AND text <> '')"


def _fusion_sql(tail, weights=(1.0, 1.0), tie="n DESC, best, "):
    return f"""WITH {_MD}, {_bm25_cte(TEXT, _CTOK)}, {_bm25_rank(DEPTH)}, q AS (SELECT vector FROM c WHERE id = 0),
de AS (SELECT id, row_number() OVER (ORDER BY {_score('cosine', 'c.vector')} DESC, id) AS rank FROM c, q QUALIFY rank <= {DEPTH}),
u AS (SELECT id, rank, {weights[0]}::DOUBLE AS w, rank AS dr, NULL AS sr FROM de UNION ALL SELECT id, rank, {weights[1]}::DOUBLE, NULL, rank FROM bm),
f AS (SELECT id, round(sum(w / (60.0::DOUBLE + rank)), 9) AS score, count(*) AS n, min(rank) AS best, CAST(max(dr) AS BIGINT) AS dense_rank, CAST(max(sr) AS BIGINT) AS sparse_rank FROM u GROUP BY id),
g AS (SELECT *, row_number() OVER (ORDER BY score DESC, {tie}CAST(id AS VARCHAR)) AS rank FROM f) {tail}"""


_FUSED = "SELECT id AS internal_id, score, dense_rank, sparse_rank, rank FROM g"


# -- inverted lists (centroids are the labels' means, so they are the same everywhere)


def label_centroids(spark, d) -> DataFrame:
    m = vectors(spark, d).select("label", F.posexplode(V.doubles(F.col("vector"))).alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg("x"), 9).alias("x"))
    return stored(m.groupBy(F.col("label").cast("long").alias("cid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")), "centroids")


def _stored_lists(spark, d, name: str, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """Written lists of the rows, and the centroids."""
    from cairn.session import shared_dir

    def make():
        path, c = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", label_centroids(spark, d)
        ivf.write_lists(vectors(spark, d).where(where), c, "l2", path)
        return path, c

    path, c = prepared(spark, d, f"lists {name}", make)
    return ivf.read_lists(spark, [path]), c


def kmeans_step(spark, d):
    v = vectors(spark, d).select("id", V.doubles(F.col("vector")).alias("vector"))
    c = v.where("id < 8").select(F.col("id").alias("cid"), "vector")
    for _ in range(3):
        c = stored(ivf.lloyd_step(v, c), "centroids")
    return c.select("cid", F.posexplode("vector").alias("pos", "x")).select("cid", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def kmeans_inertia(spark, d):
    v = vectors(spark, d)
    return ivf.inertia(v, v.where("id < 8").select(F.col("id").alias("cid"), "vector")).select(F.round("inertia", 6).alias("inertia"))


def ivf_assign(spark, d):
    return ivf.assign(vectors(spark, d), label_centroids(spark, d), "l2").select("id", "cid", F.round("distance", 6).alias("distance"))


def ivf_bucket_stats(spark, d):
    c = label_centroids(spark, d)
    s = ivf.bucket_stats(ivf.assign(vectors(spark, d), c, "l2"), c)
    return s.select("n_buckets", "min_size", "max_size", F.round("mean_size", 6).alias("mean_size"))


def _ivf(nprobe, pending=False):
    def query(spark, d):
        v, extra = vectors(spark, d), None
        if pending:  # rows that no list has yet
            (lists, c), extra = _stored_lists(spark, d, "some", "id % 5 != 0"), asking(v.where("id % 5 = 0"))
        else:
            lists, c = _stored_lists(spark, d, "all")
        return _hits(ivf.search(lists, c, asking(v), K, nprobe, "l2", pending=extra), one=False)

    return query


_CENT = """ce AS (SELECT cid, list(x ORDER BY pos) AS vector FROM (SELECT label::BIGINT AS cid, pos, round(avg(x), 9) AS x FROM
 (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v) GROUP BY ALL) GROUP BY cid)"""
_D2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _d2(a, b):
    return "round(" + _D2.format(a=a, b=b) + ", 9)"


_ASSIGN = f"asg AS (SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT v.id, ce.cid, {_d2('v.vector', 'ce.vector')} AS d FROM v, ce) GROUP BY id)"


def _ivf_sql(nprobe, pending=False, tail="SELECT qid, id AS internal_id, score, rank FROM r WHERE rank <= 10", head=""):
    cand = "SELECT p.qid, p.vector AS qv, v.id, v.vector FROM p JOIN asg ON asg.cid = p.cid JOIN v ON v.id = asg.id"
    if pending:
        cand += " WHERE v.id % 5 <> 0 UNION ALL SELECT q.qid, q.vector, v.id, v.vector FROM q, v WHERE v.id % 5 = 0"
    return f"""WITH {_V}, {_CENT}, {_ASSIGN}, q AS (SELECT id AS qid, vector FROM v),
p AS (SELECT qid, q.vector, ce.cid, row_number() OVER (PARTITION BY qid ORDER BY {_d2('q.vector', 'ce.vector')}, ce.cid) AS pr FROM q, ce QUALIFY pr <= {nprobe}),
cand AS ({cand}), s AS (SELECT qid, id, {_score('l2', 'cand.vector', 'cand.qv')} AS score FROM cand),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s){head} {tail}"""


def _lloyd_sql():
    steps = ["c0 AS (SELECT id AS cid, vector FROM v WHERE id < 8)"]
    for i in range(3):
        steps.append(
            f"""a{i} AS (SELECT id, arg_min(cid, (d, cid)) AS cid FROM (SELECT v.id, c.cid, {_d2('v.vector', 'c.vector')} AS d FROM v, c{i} c) GROUP BY id),
m{i} AS (SELECT cid, pos, avg(x) AS x FROM (SELECT a.cid, unnest(v.vector) AS x, unnest(range(1, len(v.vector) + 1)) AS pos FROM v JOIN a{i} a USING (id)) GROUP BY ALL),
n{i} AS (SELECT cid, list(x ORDER BY pos) AS vector FROM m{i} GROUP BY cid),
c{i + 1} AS (SELECT c.cid, coalesce(n.vector, c.vector) AS vector FROM c{i} c LEFT JOIN n{i} n USING (cid))"""
        )
    return f"WITH {_V}, " + ",\n".join(steps) + " SELECT cid, unnest(range(0, len(vector))) AS pos, round(unnest(vector), 6) AS x FROM c3"


# -- quality


def _retrieved(spark, d) -> DataFrame:
    lists, c = _stored_lists(spark, d, "all")
    return ivf.search(lists, c, asking(vectors(spark, d)), K, 2, "l2")


def recall_at_k(spark, d):
    v = vectors(spark, d)
    return evaluate.recall_at_k(_retrieved(spark, d), knn.knn(v, asking(v), K, "l2"), K).select("qid", F.round("recall", 6).alias("recall"))


def _relevant(spark, d, retrieved) -> DataFrame:
    """Relevance of what was retrieved, and K relevant rows of each query for the ideal: all gains are 1, so others change nothing."""
    v = vectors(spark, d).select("id", "label")
    q = v.select(F.col("id").alias("qid"), "label")
    hits = retrieved.select("qid", "id").join(v, "id").join(q, ["qid", "label"]).select("qid", "id")
    some = v.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= K)
    return hits.union(q.join(some, "label").select("qid", "id")).distinct().withColumn("gain", F.lit(1.0))


def ndcg_at_k(spark, d):
    found = stored(_retrieved(spark, d), "retrieved")
    return evaluate.ndcg_at_k(found, _relevant(spark, d, found), K).select("qid", F.round("ndcg", 6).alias("ndcg"))


def mrr_at_k(spark, d):
    found = stored(_retrieved(spark, d), "retrieved")
    return evaluate.mrr_at_k(found, _relevant(spark, d, found), K).select("qid", F.round("rr", 6).alias("rr"))


def latency_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events"), "value", [50, 95, 99, 99.9])


def pareto_front(spark, d):
    """Per label: how many vectors it has against their mean first number, as an example of two measures."""
    points = vectors(spark, d).groupBy("label").agg(F.count("*").alias("qps"), F.round(F.avg(F.element_at("vector", 1).cast("double")), 6).alias("recall"))
    return evaluate.pareto_front(points, "qps", "recall").select("label", "qps", "recall")


def _graphs(spark, d, ef, shards):
    return prepared(spark, d, f"graphs {ef} {shards}", lambda: stored(hnsw.build(vectors(spark, d), "cosine", 16, ef, shards=shards), "graph"))


def hnsw_search(spark, d):
    """A beam as wide as the shard makes the walk of a connected graph exact."""
    v = vectors(spark, d)
    n = v.count()
    return _hits(hnsw.search(_graphs(spark, d, 64, max(1, n // 500)), asking(v), K, "cosine", ef_search=n), one=False)


def hnsw_ef64(spark, d):
    """The default beam, on shards of the default size."""
    return _hits(hnsw.search(_graphs(spark, d, 200, None), asking(vectors(spark, d)), K, "cosine", ef_search=64), one=False)


def hnsw_recall(spark, d):
    """Whether the default beam finds 95 % of the true neighbours."""
    found, true = hnsw_ef64(spark, d).withColumnRenamed("internal_id", "id"), knn_batch(spark, d).withColumnRenamed("internal_id", "id")
    return evaluate.recall_at_k(found, true, K).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.95).alias("floor_met"))


def hnsw_levels(spark, d):
    return hnsw.levels(hnsw.build(vectors(spark, d), "cosine", 16, 64, shards=4))


def _copy(spark, d, **options):
    from cairn.session import shared_dir
    from cairn.sources.collection import Collection

    c = Collection.create(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", 64, text_field="text", **options)
    rows = collection(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label", "lang", "source", "text")).alias("metadata"))
    return c, rows


def checkpoint_reopen(spark, d):
    from cairn.sources.collection import Collection

    c, rows = _copy(spark, d, index_type="ivf", index_params={"nlist": 8})
    c.insert(rows)
    c.checkpoint()
    c.delete("3")
    again = Collection.open(spark, c.path)
    return again.live().select("id")


def stream_ingest(spark, d):
    from cairn.session import shared_dir
    from cairn.streaming.ingest import ingest

    c, rows = _copy(spark, d)
    rows = stored(rows, "stream")
    path = rows.inputFiles()[0].rpartition("/")[0]
    ingest(spark.readStream.schema(rows.schema).parquet(path), c, f"{shared_dir(spark)}/offsets-{c.path.rpartition('-')[2]}").awaitTermination()
    return c.live().select("id")


def stream_replay(spark, d):
    """Every micro-batch twice, with a checkpoint between: the second time nothing happens."""
    c, rows = _copy(spark, d)
    parts = [rows.where(f"cast(id as long) % 2 = {i}") for i in (0, 1)]
    for i, part in enumerate(parts):
        c.insert(part, upsert=True, batch=("s", i))
    c.checkpoint()
    for i, part in enumerate(parts):
        c.insert(part, upsert=True, batch=("s", i))
    s = c.stats()
    return spark.createDataFrame([(s["num_vectors"], s["num_deleted"])], "num_vectors long, num_deleted long")


def two_writers(spark, d):
    """Two handles of one collection insert in turn; no batch is lost."""
    from cairn.sources.collection import Collection

    c, rows = _copy(spark, d)
    other = Collection.open(spark, c.path)
    c.insert(rows.where("cast(id as long) % 2 = 0"))
    other.insert(rows.where("cast(id as long) % 2 = 1"))
    return Collection.open(spark, c.path).iter_ids()


_PAIRS: dict[str, tuple] = {
    "normalize": (normalize, f"WITH {_S} SELECT id, unnest(range(0, len(vector))) AS pos, round(unnest(vector) / greatest(sqrt(list_inner_product(vector, vector)), 1e-12), 6) AS x FROM v"),
    "pairwise_distance": (pairwise_distance, f"WITH {_S} SELECT q.id AS qid, v.id AS internal_id, {_score('l2')} AS distance FROM v, v q"),
    **{f"flat_knn_{m}": (_flat(m), _knn_sql(m, _S)) for m in ("cosine", "dot", "l2")},
    "knn_batch": (knn_batch, _knn_sql("cosine", queries="TRUE", columns="qid, id AS internal_id, score, rank")),
    "filter_eq": (_filter({"lang": "de"}), _filter_sql("lang = 'de'")),
    "filter_in": (_filter({"label": [1, 2, 3]}), _filter_sql("label IN (1, 2, 3)")),
    "filter_and": (_filter({"lang": "en", "label": 4}), _filter_sql("lang = 'en' AND label = 4")),
    "filter_missing": (_filter({"lang": None}), _filter_sql("lang IS NULL")),
    "filter_empty_list": (_filter({"lang": []}), _filter_sql("FALSE")),
    "knn_post_filter": (knn_post_filter, f"WITH {_MD}, q AS (SELECT vector FROM c WHERE id = 0), s AS (SELECT id, lang, {_score('cosine', 'c.vector')} AS score FROM c, q ORDER BY score DESC, id LIMIT {fetch_size(K, True)}) SELECT id AS internal_id, score FROM s WHERE lang IN ('de', 'fr') ORDER BY score DESC, id LIMIT {K}"),
    "knn_pre_filter": (knn_pre_filter, f"WITH {_MD}, q AS (SELECT vector FROM c WHERE id = 0), s AS (SELECT id, {_score('cosine', 'c.vector')} AS score FROM c, q WHERE lang IN ('de', 'fr')) SELECT id AS internal_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {K}"),
    "knn_tombstones": (knn_tombstones, _knn_sql("cosine", where="v.id % 10 <> 3")),
    "delete_view": (delete_view, "SELECT vec_id AS internal_id, label FROM embeddings WHERE vec_id % 10 <> 3"),
    "upsert_latest": (upsert_latest, f"WITH {_LOG} SELECT id, internal_id, round(x0, 6) AS x0 FROM live"),
    "optimize_renumber": (optimize_renumber, f"WITH {_LOG} SELECT id, internal_id AS old_internal_id, row_number() OVER (ORDER BY internal_id) - 1 AS internal_id FROM live"),
    "insert_conflicts": (insert_conflicts, "SELECT vec_id * 3 AS id FROM embeddings WHERE vec_id * 3 IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 3)"),
    "collection_counts": (collection_counts, f"WITH {_LOG} SELECT {_COUNTS}"),
    "collection_summary": (collection_summary, f"WITH {_LOG} SELECT (SELECT max(len(vector)) FROM e)::BIGINT AS dimension, 'l2' AS metric, {_COUNTS}"),
    "point_lookup": (point_lookup, f"WITH {_MD} SELECT CAST(id AS VARCHAR) AS id, label, lang, source, n_chars, round(vector[1], 6) AS x0 FROM c WHERE id = 42"),
    "contains": (contains, f"WITH {_LOG} SELECT p.id, p.id IN (SELECT id FROM live) AS found FROM (VALUES ('42'), ('43'), ('nothing')) p(id)"),
    "live_ids": (live_ids, f"WITH {_LOG} SELECT id FROM live"),
    "tokenize": (tokenize, f"WITH {_TOK} SELECT id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS term FROM t"),
    "bm25_tf": (bm25_tf, f"WITH {_TOK}, {_POST} SELECT term, id, tf FROM tf"),
    "bm25_df_idf": (bm25_df_idf, f"WITH {_TOK}, {_POST} SELECT term, df, round(idf, 6) AS idf FROM df"),
    "bm25_stats": (bm25_stats, f"WITH {_TOK}, {_POST} SELECT n_docs, total_len, round(avgdl, 6) AS avgdl FROM st"),
    "bm25_vocab": (bm25_vocab, f"WITH {_TOK}, {_POST} SELECT count(*) AS vocabulary_size, CAST(sum(df) AS BIGINT) AS n_postings FROM df"),
    "bm25_search": (_bm25(TEXT), f"WITH {_bm25_cte(TEXT)}, {_bm25_rank(K)} SELECT id AS internal_id, score, rank FROM bm"),
    "bm25_repeated_terms": (_bm25("trash trash license"), f"WITH {_bm25_cte('trash trash license')}, {_bm25_rank(K)} SELECT id AS internal_id, score, rank FROM bm"),
    "bm25_tombstones": (_bm25(TEXT, dead=True), f"WITH {_bm25_cte(TEXT, _TOK[:-1] + ' AND doc_id % 10 <> 3)')}, {_bm25_rank(K)} SELECT id AS internal_id, score, rank FROM bm"),
    "bm25_explain": (bm25_explain, _explain_sql()),
    "bm25_batch": (bm25_batch, f"""WITH {_TOK}, {_POST}, q AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[1:4] AS ws FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(ws) AS term FROM q) GROUP BY ALL), dl AS (SELECT id, len(tokens) AS n FROM t),
co AS (SELECT qid, tf.id, qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.n / avgdl)) AS c FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.id = tf.id, st)
SELECT qid, id AS internal_id, round(sum(c), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(c), 6) DESC, id) AS rank FROM co GROUP BY qid, id QUALIFY rank <= {K}"""),
    "rrf_fuse": (rrf_fuse, _fusion_sql(_FUSED)),
    "weighted_rrf": (weighted_rrf, _fusion_sql(_FUSED + f" WHERE rank <= {K}", (0.7, 0.3), "")),
    "hybrid_search": (hybrid_search, _fusion_sql(_FUSED + f" WHERE rank <= {K}")),
    "hybrid_filter": (hybrid_filter, _fusion_sql(f"SELECT g.id AS internal_id, score FROM g JOIN c USING (id) WHERE lang = 'en' ORDER BY rank LIMIT {K}")),
    "kmeans_step": (kmeans_step, _lloyd_sql()),
    "kmeans_inertia": (kmeans_inertia, f"WITH {_V}, c0 AS (SELECT id AS cid, vector FROM v WHERE id < 8) SELECT round(sum(d), 6) AS inertia FROM (SELECT v.id, min({_d2('v.vector', 'c.vector')}) AS d FROM v, c0 c GROUP BY v.id)"),
    "ivf_assign": (ivf_assign, f"WITH {_V}, {_CENT}, {_ASSIGN} SELECT id, cid, round(d, 6) AS distance FROM asg"),
    "ivf_bucket_stats": (ivf_bucket_stats, f"WITH {_V}, {_CENT}, {_ASSIGN}, n AS (SELECT ce.cid, count(asg.id) AS n FROM ce LEFT JOIN asg USING (cid) GROUP BY ce.cid) SELECT count(*) AS n_buckets, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM n"),
    "ivf_search": (_ivf(2), _ivf_sql(2)),
    "ivf_pending": (_ivf(2, True), _ivf_sql(2, True)),
    "ivf_full_probe": (_ivf(10_000), _knn_sql("l2", queries="TRUE", columns="qid, id AS internal_id, score, rank")),
    "recall_at_k": (recall_at_k, _ivf_sql(2, head=f", tr AS (SELECT q.qid, v.id, row_number() OVER (PARTITION BY q.qid ORDER BY {_score('l2')}, v.id) AS rank FROM v, q QUALIFY rank <= 10)", tail="SELECT tr.qid, round(count(r.id) / 10.0::DOUBLE, 6) AS recall FROM tr LEFT JOIN r ON r.qid = tr.qid AND r.id = tr.id AND r.rank <= 10 GROUP BY tr.qid")),
    "ndcg_at_k": (ndcg_at_k, _ivf_sql(2, head=", rel AS (SELECT a.vec_id AS qid, b.vec_id AS id FROM embeddings a JOIN embeddings b USING (label)), ideal AS (SELECT qid, sum(1 / log2(i + 1)) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id) AS i FROM rel QUALIFY i <= 10) GROUP BY qid)", tail="SELECT r.qid, round(coalesce(sum(CASE WHEN rel.id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) / max(idcg), 6) AS ndcg FROM r JOIN ideal USING (qid) LEFT JOIN rel ON rel.qid = r.qid AND rel.id = r.id WHERE rank <= 10 GROUP BY r.qid")),
    "mrr_at_k": (mrr_at_k, _ivf_sql(2, head=", rel AS (SELECT a.vec_id AS qid, b.vec_id AS id FROM embeddings a JOIN embeddings b USING (label))", tail="SELECT r.qid, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel.id IS NOT NULL THEN rank END), 0), 6) AS rr FROM r LEFT JOIN rel ON rel.qid = r.qid AND rel.id = r.id WHERE rank <= 10 GROUP BY r.qid")),
    "latency_percentiles": (latency_percentiles, "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p::DOUBLE AS p, value FROM s, (VALUES (50.0), (95.0), (99.0), (99.9)) w(p) WHERE i = least(greatest(CAST(round_even(p::DOUBLE / 100 * n + 0.5, 0) AS BIGINT) - 1, 0), n - 1)"),
    "pareto_front": (pareto_front, "WITH pt AS (SELECT label, count(*) AS qps, round(avg(embedding[1]::DOUBLE), 6) AS recall FROM embeddings GROUP BY label), b AS (SELECT *, max(recall) OVER (ORDER BY qps DESC, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pt) SELECT label, qps, recall FROM b WHERE best IS NULL OR recall > best"),
    "hnsw_search": (hnsw_search, _knn_sql("cosine", queries="TRUE", columns="qid, id AS internal_id, score, rank")),
    "hnsw_ef64": (hnsw_ef64, None),
    "hnsw_recall": (hnsw_recall, "SELECT count(*) AS queries, TRUE AS floor_met FROM embeddings"),
    "hnsw_levels": (hnsw_levels, None),
    "checkpoint_reopen": (checkpoint_reopen, "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id <> 3"),
    "stream_replay": (stream_replay, "SELECT count(*) AS num_vectors, 0::BIGINT AS num_deleted FROM embeddings"),
    "two_writers": (two_writers, "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings"),
    "stream_ingest": (stream_ingest, "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings"),
}

QUERIES = {name: q for name, (q, _) in _PAIRS.items()}
SQL = {name: s for name, (_, s) in _PAIRS.items() if s}
