"""Reciprocal rank fusion of any number of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.model import InvalidRequest
from cairn.operators.bm25 import numbered

K = 60


def labelled(rankings: dict[str, DataFrame] | list[DataFrame]) -> DataFrame:
    """(ranker, id, rank): the union of the rankings (id, rank). Of a repeated id the first place counts; it uses up its other places."""
    if not isinstance(rankings, dict):
        rankings = {f"ranker_{i}": r for i, r in enumerate(rankings)}
    parts = [r.groupBy("id").agg(F.min("rank").alias("rank")).select(F.lit(n).alias("ranker"), "id", "rank") for n, r in rankings.items()]
    return reduce(DataFrame.unionByName, parts)


def rrf(rankings: dict[str, DataFrame] | list[DataFrame], k: int = K, top_k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, n_rankers, best_rank, ranks, rank): by score, number of rankers, best rank, then the id as text.

    With ``weights`` (a weight for each ranker) ties go to the id as text directly after the score.
    """
    if k < 0:
        raise InvalidRequest("k must not be negative")
    u = labelled(rankings)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("ranker") == name, F.lit(float(w))).otherwise(weight)
    fused = u.groupBy("id").agg(
        F.round(F.sum(weight / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_rankers"), F.min("rank").alias("best_rank"), F.map_from_entries(F.collect_list(F.struct("ranker", "rank"))).alias("ranks")
    )
    order = [F.desc("score")] + ([] if weights else [F.desc("n_rankers"), F.col("best_rank")]) + [F.col("id").cast("string")]
    fused = fused.orderBy(*order)
    return numbered(fused.limit(top_k) if top_k is not None else fused, order)
