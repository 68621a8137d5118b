"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character bigrams and trigrams (letters in lower case, any other
run is one space); TF is logarithmic, document frequencies are counted over all documents. Each language has several
centroids, found by spherical k-means on a bounded sample of rows with a language label. The answer is the language of the
nearest centroid by cosine. A text is rejected (language "und") if its cosine distance to that centroid is larger than the
language's limit, which falls with the number of n-grams: short texts lie far from any centroid by chance.

Nulls and texts without a letter have no vector: language null, distance 1, not rejected unless ``reject_empty``.
Equal distances go to the language that is first in the alphabet. Rows are judged one by one, so repeated rows have equal results;
very long texts are one vector like others. An empty table, or one without a language label, gives null languages. Of the frame only key,
text and lang are read, whatever its other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops

SIZES = (2, 3)
DIMS = 1 << 12
#: Labelled rows of a language that its centroids are fitted on, at most; and its centroids.
SAMPLE_PER_LANGUAGE, CENTROIDS = 1000, 4
#: Languages that are known, the most frequent labels; labelled rows of all of them together, at most.
LANGUAGES, SAMPLE = 128, 32_000
#: A text is rejected beyond this quantile of the training distances (of texts of its length class) plus the margin.
QUANTILE, MARGIN = 0.999, 0.15
_CLASSES = np.array([0, 8, 32, 128, 512, 2048])
_CELLS = 1 << 20


def counts(texts: list[str | None]):
    """(first row, counts matrix) for slices of the texts that have bounded size."""
    grams = textops.char_grams(texts, SIZES, DIMS, letters=True)
    step = _CELLS // DIMS
    for a in range(0, len(texts), step):
        b = min(len(texts), a + step)
        m = np.zeros((b - a) * DIMS, np.float32)
        for buckets, at in grams:
            part = buckets[at[a] : at[b]]
            row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
            m += np.bincount(row * DIMS + part, minlength=len(m))
        yield a, m.reshape(b - a, DIMS)


def vectors(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (zero rows stay)."""
    x = np.log1p(m)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are far from each other."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        to = (x @ c.T).argmax(1)
        new = np.stack([x[to == j].sum(0) if (to == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1), 1e-12)[:, None]
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c.astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those that have each n-gram bucket; one vector comes back from each task."""

    def run(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in textops.passes(texts):
                for _, m in counts(texts[a:b]):
                    n += len(m)
                    df += (m > 0).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.astype(np.int64).tolist()]}, schema=pa.schema([("n", pa.int64()), ("df", pa.list_(pa.int64()))]))

    common.bounded_batches()
    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "n long, df array<long>")
    rows = parts.select("n", F.posexplode("df").alias("i", "c")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    df = np.zeros(DIMS, np.int64)
    for r in rows:
        df[r.i] = r.c
    return (rows[0].n if rows else 0), df


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> dict | None:
    """IDF, centroids with their languages, and limits; None if no row has a language and a letter."""
    n, df = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    labelled = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())

    # a column of dirty labels doesn't make the model grow
    known = [r.l for r in labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()]
    labelled, sample = labelled.where(F.col("l").isin(known)), min(sample, SAMPLE // max(1, len(known)))

    def sparse(texts: list) -> dict:
        return {"b": [np.flatnonzero(v).astype(np.uint16).tobytes() for _, m in counts(texts) for v in m], "c": [v[v > 0].tobytes() for _, m in counts(texts) for v in m]}

    rows = common.sample_rows(labelled, "k", sample, "l").select("l", common.text_udf("b binary, c binary", sparse)("t").alias("s")).select("l", "s.*").collect()
    names = sorted({r.l for r in rows})
    cs, owner, limits = [], [], []
    for j, name in enumerate(names):
        m = np.zeros((sum(r.l == name for r in rows), DIMS), np.float32)
        for i, r in enumerate(r for r in rows if r.l == name):
            m[i, np.frombuffer(r.b, np.uint16)] = np.frombuffer(r.c, np.float32)
        size, x = m.sum(1), vectors(m, idf)
        size, x = size[(ok := size > 0)], x[ok]
        if not len(x):
            limits.append(np.ones(len(_CLASSES)))
            continue
        c = kmeans(x, centroids)
        far = 1 - (x @ c.T).max(1)
        kind = np.searchsorted(_CLASSES, size, side="right") - 1
        limit = [min(1.0, float(np.quantile(far[kind == q], QUANTILE)) + MARGIN) if (kind == q).sum() >= 20 else np.nan for q in range(len(_CLASSES))]
        longer = far[kind >= 2]
        pooled = min(1.0, float(np.quantile(longer, QUANTILE)) + MARGIN) if len(longer) >= 10 else 1.0
        for q in range(len(limit)):  # a class with few rows takes the limit of the next shorter one, else that of all but the shortest
            if np.isnan(limit[q]):
                limit[q] = 1.0 if q < 2 else limit[q - 1] if limit[q - 1] < 1 else pooled
        cs.append(c)
        owner += [j] * len(c)
        limits.append(np.maximum.accumulate(np.array(limit)[::-1])[::-1])
    m = x = rows = None
    textops.tidy()  # the driver has little memory beside its JVM
    if not cs:
        return None
    return {"idf": idf, "centroids": np.concatenate(cs), "owner": np.array(owner), "names": names, "limits": np.array(limits, np.float64)}


def scorer(model: dict | None):
    """Column function text -> struct(language, distance, rejected)."""

    def work(texts: list) -> dict:
        if model is None:
            return {"language": [None] * len(texts), "distance": [1.0] * len(texts), "rejected": [False] * len(texts)}
        names, far, out = [], [], []
        for _, m in counts(texts):
            size = m.sum(1)
            s = vectors(m, model["idf"]) @ model["centroids"].T
            best = s.argmax(1)
            who = model["owner"][best]
            d = np.round(1 - s[np.arange(len(s)), best].astype(np.float64), 6)
            over = d > model["limits"][who, np.searchsorted(_CLASSES, size, side="right") - 1]
            has = size > 0
            names += [model["names"][w] if h and not o else ("und" if h else None) for w, h, o in zip(who, has, over)]
            far.append(np.where(has, d, 1.0))
            out.append(has & over)
        return {"language": names, "distance": np.concatenate(far) if far else [], "rejected": np.concatenate(out) if out else []}

    return common.text_udf("language string, distance double, rejected boolean", work)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, language, distance, rejected) of every row."""
    found = scorer(fit(docs))(F.col("text").cast("string"))
    return docs.select("doc_id", found.alias("f")).select("doc_id", "f.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    return docs.where(~scorer(fit(docs))(F.col("text").cast("string"))["rejected"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
