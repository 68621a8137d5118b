"""Retrieval quality: recall, nDCG, MRR; nearest-rank percentiles; the Pareto front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_at_k(retrieved: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the truth's first k (qid, id, rank) found among the retrieved first k."""
    t = truth.where(F.col("rank") <= k).select("qid", "id")
    r = retrieved.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    return t.join(r, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def ndcg_at_k(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg) of retrieved (qid, id, rank) for relevance (qid, id, gain); 0 without relevant rows."""
    dcg = retrieved.where(F.col("rank") <= k).join(relevant, ["qid", "id"]).groupBy("qid").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("qid").orderBy(F.desc("gain"), "id")
    ideal = relevant.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("idcg"))
    q = retrieved.select("qid").distinct()
    return q.join(dcg, "qid", "left").join(ideal, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def mrr_at_k(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, rr): 1 / rank of the first relevant row, 0 if there is none."""
    first = retrieved.where(F.col("rank") <= k).join(relevant.where("gain > 0"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    return retrieved.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def ground_truth(corpus: DataFrame, queries: DataFrame, k: int, metric: str, path: str) -> DataFrame:
    """The exact (qid, id, score, rank), computed once: kept as a table at ``path``, read from there if it exists."""
    from cairn.operators import knn
    from cairn.sources.files import Files

    spark = corpus.sparkSession
    if not Files(spark).exists(f"{path}/_SUCCESS"):
        knn.knn(corpus, queries, k, metric).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def percentiles(values: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """(p, value): nearest rank, the index being round-half-even of p n / 100 + 0.5, less 1, within the sample.

    The values are range-sorted and each range is numbered for itself, so no task sorts them all.
    """
    from cairn.session import with_ordinals

    some = with_ordinals(values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")), ["value"], "i")
    n = some.agg(F.count("*").alias("n"))
    p = values.sparkSession.createDataFrame([(float(x),) for x in ps], "p double").crossJoin(n)
    at = p.select("p", F.least(F.greatest(F.bround(F.col("p") / 100 * F.col("n") + 0.5, 0).cast("long") - 1, F.lit(0)), F.col("n") - 1).alias("i"))
    return some.join(F.broadcast(at), "i").select("p", "value")


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Rows for which no row with at least that x has a greater or equal y (of equal rows the first by order stays)."""
    w = Window.orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("__b", F.max(y).over(w)).where(F.col("__b").isNull() | (F.col(y) > F.col("__b"))).drop("__b")
