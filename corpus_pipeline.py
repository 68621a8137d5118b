"""The corpus pipeline: documents to mixed, tokenised training data, one stage after another.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, langid, mixing, njaccard, sptok, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every language go; the others get the language found (a text without letters keeps its own)."""
    found = langid.scorer(langid.fit(docs)).asNondeterministic()(F.col("text").cast("string")).alias("found")  # computed once
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), found).where(~F.col("found.rejected"))
    return kept.select(*[(F.coalesce("found.language", "row.lang") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return njaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the curriculum's order, which the encoding keeps as ``place``."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its ``place``: rows ordered by it are the curriculum."""
    return sptok.encode(common.placed(docs, "place"), keep=("place",))


STAGES = [
    ("toxicity", remove_toxic),
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No SQL expresses the trained classifiers, the join's groups or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
