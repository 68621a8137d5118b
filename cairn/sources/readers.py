"""Readers of records and query vectors, and seeded generators."""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.model import InvalidRequest
from cairn.sources.files import Files

RECORDS = "id string, vector array<float>, metadata string"


def _record(value, where: str) -> tuple:
    if not isinstance(value, dict) or "id" not in value or "vector" not in value:
        raise InvalidRequest(f"{where}: a record needs an id and a vector")
    return str(value["id"]), [float(x) for x in value["vector"]], json.dumps(value.get("metadata") or {}, sort_keys=True)


def parse_items(text: str, name: str = "-") -> list[tuple]:
    """Records of a JSON array or of JSON lines; blank lines don't count."""
    if text.lstrip().startswith("["):
        found = [_record(v, f"{name}[{i}]") for i, v in enumerate(json.loads(text))]
    else:
        found = []
        for i, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    found.append(_record(json.loads(line), f"{name}:{i}"))
                except ValueError as e:
                    raise InvalidRequest(f"{name}:{i}: {e}") from None
    if not found:
        raise InvalidRequest(f"{name}: no records")
    return found


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Records (id, vector, metadata as JSON text). "-" is the standard input; a JSON array is read whole, JSON lines in parallel."""
    if path == "-":
        return spark.createDataFrame(parse_items(sys.stdin.read()), RECORDS)
    head = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    if not head:
        raise InvalidRequest(f"{path}: no records")
    if head[0].value.lstrip().startswith("["):
        return spark.createDataFrame(parse_items(Files(spark).read(path), path), RECORDS)
    lines = spark.read.text(path).where("trim(value) != ''")
    v = F.try_parse_json("value")
    bad = lines.where(v.isNull() | F.variant_get(v, "$.id", "variant").isNull() | F.variant_get(v, "$.vector", "variant").isNull()).limit(1).collect()
    if bad:
        raise InvalidRequest(f"{_place(spark, path, bad[0].value)}: a record needs an id and a vector")
    return lines.select(v.alias("v")).select(F.variant_get("v", "$.id", "string").alias("id"), F.variant_get("v", "$.vector", "array<float>").alias("vector"), F.coalesce(F.to_json(F.variant_get("v", "$.metadata", "variant")), F.lit("{}")).alias("metadata"))


def _place(spark: SparkSession, path: str, line: str) -> str:
    """Where a bad line stands: its number in the first file that has it. Files are read one line at a time, and only on an error."""
    files = spark.read.text(path).where(F.col("value") == line).select(F.input_file_name()).limit(1).collect()
    name = files[0][0] if files else path
    for i, text in enumerate(Files(spark).lines(name), 1):
        if text == line:
            return f"{name}:{i}"
    return name


def parse_vector(text: str) -> list[float]:
    """Numbers separated by commas, a JSON array, or an object with a vector."""
    t = text.strip()
    try:
        if t.startswith("{"):
            return [float(x) for x in json.loads(t)["vector"]]
        return [float(x) for x in (json.loads(t) if t.startswith("[") else t.split(","))]
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidRequest(f"not a vector: {e}") from None


def gaussian(spark: SparkSession, rows: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, vector) drawn from a normal distribution; each row depends on its id and the seed alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            x = [np.random.default_rng((seed, i)).standard_normal(dimension).astype(np.float32).tolist() for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.list_(pa.float32()))], names=["id", "vector"])

    return spark.range(rows).mapInArrow(run, "id long, vector array<float>")


def clustered(spark: SparkSession, rows: int, dimension: int, clusters: int = 8, spread: float = 1.0, apart: float = 6.0, seed: int = 42) -> DataFrame:
    """(id, vector, label) around cluster centres; each row depends on its id and the seed alone, the centres on the seed."""

    def run(batches):
        import pyarrow as pa

        centres = np.random.default_rng((seed, 1 << 40)).standard_normal((clusters, dimension)) * apart
        for batch in batches:
            x, labels = [], []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng((seed, i))
                labels.append(int(rng.integers(clusters)))
                x.append((centres[labels[-1]] + spread * rng.standard_normal(dimension)).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32())), pa.array(labels, pa.int32())], names=["id", "vector", "label"])

    return spark.range(rows).mapInArrow(run, "id long, vector array<float>, label int")


def topical(spark: SparkSession, rows: int, dimension: int = 64, topics: int = 8, rare: int = 40, share: float = 0.05, words: int = 20, seed: int = 42) -> DataFrame:
    """(id, text, vector, topic, rare): passages of filler words whose vectors tell the topic and whose texts may hold a rare term.

    A query for a topic and a rare term needs both: relevant are the rows that have the two, so fusion beats either ranking.
    """

    def run(batches):
        import pyarrow as pa

        centres = np.random.default_rng((seed, 1 << 40)).standard_normal((topics, dimension))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng((seed, i))
                topic, term = int(rng.integers(topics)), int(rng.integers(rare)) if rng.random() < share else None
                text = [f"filler{w}" for w in rng.integers(0, 200, words)]
                if term is not None:
                    text[int(rng.integers(words))] = f"rare{term}"
                v = centres[topic] + rng.standard_normal(dimension)
                for c, x in zip(out, (" ".join(text), (v / np.linalg.norm(v)).astype(np.float32).tolist(), topic, term)):
                    c.append(x)
            kinds = (pa.string(), pa.list_(pa.float32()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["id", "text", "vector", "topic", "rare"])

    return spark.range(rows).mapInArrow(run, "id long, text string, vector array<float>, topic int, rare int")


def zipf_text(spark: SparkSession, rows: int, words: int, vocabulary: int, a: float = 1.3, seed: int = 0) -> DataFrame:
    """(id, text) of words w0, w1, ... with Zipf frequencies."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            t = [" ".join(f"w{(z - 1) % vocabulary}" for z in np.random.default_rng((seed, i)).zipf(a, words)) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(t)], names=["id", "text"])

    return spark.range(rows).mapInArrow(run, "id long, text string")


def prefix(corpus: DataFrame, queries: DataFrame, rows: int, n_queries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first rows of a data set by id; its ground truth has to be computed anew."""
    return corpus.where(corpus.id < rows), queries if n_queries is None else queries.where(queries.id < n_queries)
