"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textops
from cairn.session import BROADCAST_IDS, by_ids, discard, stored  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sample_rows(df: DataFrame, key: str, bound: int, per: str | None = None) -> DataFrame:
    """At most ``bound`` rows (for each value of ``per``): those whose key has the least hash, so the same at any partitioning.

    Rows with a null key aren't drawn. Only the key (and ``per``) go through the sort; the rows follow by a semi join
    with a side whose size is bounded by the parameter.
    """
    from pyspark.sql import Window as W

    cols = [F.col(key).alias("__k")] + ([F.col(per).alias("__p")] if per else [])
    ids = df.where(F.col(key).isNotNull()).select(*cols).distinct() if per else df.where(F.col(key).isNotNull()).select(*cols)
    ids = ids.withColumn("__h", F.xxhash64("__k"))
    if per:
        ids = ids.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy("__h", "__k"))).where(F.col("__r") <= bound)
    else:
        ids = ids.orderBy("__h", "__k").limit(bound)
    return df.join(F.broadcast(ids.select(F.col("__k").alias(key)).distinct()), key, "left_semi")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """The key, text and place (as ``name``, ascending in the frame's order) of every row.

    Spark reads a table's files in any order and in parts, so for rows of files the place is that in the table as written: the
    number of the file's task, the file's number in it, the row's in the file. Other frames are numbered as they come.
    """
    try:
        file, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
        part, more = (F.coalesce(F.regexp_extract(file, x, 1).try_cast("long"), F.lit(0)) for x in ("^part-([0-9]+)", "-c([0-9]+)[^-]*$"))
        return docs.select("doc_id", "text", (F.shiftleft(part, 42) + F.shiftleft(more, 32) + row).alias(name))
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias(name))


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking for a smooth convex function."""
    f, g = fun(x)
    ss: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(ss), reversed(ys)):
            alphas.append(a := (s @ q) / (y @ s))
            q -= a * y
        q *= (ss[-1] @ ys[-1]) / (ys[-1] @ ys[-1]) if ss else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, y), a in zip(zip(ss, ys), reversed(alphas)):
            q += (a - (y @ q) / (y @ s)) * s
        step, slope = 1.0, -(g @ q)
        if slope > -1e-12:
            break
        for _ in range(25):
            f2, g2 = fun(x - step * q)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g2 - g
        if s @ y > 1e-12:
            ss, ys = (ss + [s])[-memory:], (ys + [y])[-memory:]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = x - step * q, f2, g2
        if done:
            break
    return x


#: Bytes of an Arrow batch. Rows can be very long, and a worker holds a batch several times over.
BATCH_BYTES = 4 << 20


def bounded_batches() -> None:
    """Make Arrow batches small in the active session, unless it was told to make them smaller."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", SparkSession.active()
    now = spark.conf.get(name, "64m")
    if now in ("64m", "64MB", "67108864", "67108864b", str((1 << 31) - 1)):
        spark.conf.set(name, str(BATCH_BYTES))


def text_udf(schema: str, work: Callable[[list], dict | list], after: Callable[[], None] | None = None):
    """A Column function over one text column, run on Arrow batches in passes of bounded size.

    ``work`` gets a list of texts (None for null) and returns one list of values, or for a struct a dict of lists.
    The frame's other columns never leave the JVM, so extra or clashing names don't matter. ``after`` runs at a task's end.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    bounded_batches()
    target = _parse_datatype_string(schema)
    if isinstance(target, StructType) and " " not in schema:  # one type, which the parser wraps
        target = target.fields[0].dataType

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(target)
        for batch in batches:
            texts, parts = batch.to_pylist(), []
            for a, b in textops.passes(texts):
                out = work(texts[a:b])
                if isinstance(out, dict):
                    fields = [out[f.name] for f in kind]
                    parts.append(pa.StructArray.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fields, kind)], fields=list(kind)))
                else:
                    parts.append(out.cast(kind) if isinstance(out, pa.Array) else pa.array(out, kind))
            out = pa.concat_arrays(parts) if parts else pa.array([], kind)
            del texts, parts, batch
            yield out
            del out
        if after:
            after()
        textops.tidy()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, target)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the nodes of the edges (u, v): root is the least node of the connected component.

    Alternates large-star and small-star steps; every round is a written table, so lineage stays short. The least neighbour
    comes by an aggregation and a join, so a node with very many neighbours is pre-aggregated and its rows can be split.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")

    state = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        made = stored(pairs.observe(seen, *state), name)
        return made, (seen.get["n"], seen.get["h"])

    now, at = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    last = None
    while at[0] and at != last:
        large = least(now.union(now.select("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least(large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u != v").distinct()
        before, last = now, at
        now, at = written(small)
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
