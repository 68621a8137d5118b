"""Document quality: a calibrated logistic regression on hashed word and character n-grams.

Features are counts of hashed words, word pairs and raw character trigrams and 4-grams (symbols and capitals included), as
log frequencies scaled to unit length, so long and short texts are alike. The weights are fitted on a bounded sample of
labelled rows; on rows of the sample that were held out a sigmoid of the score is fitted (Platt scaling), which makes scores
probabilities. Texts are scored in Arrow batches against fixed thresholds.

Nulls and texts without a character have no features: probability null, verdict "review" (they are not rejected here).
Each row is judged for itself, so ties and repeated rows have equal results; very long texts are read whole. If the labels have not both
classes, every probability is 0.5 (verdict "review"); an empty table gives an empty result. Labels that contradict each other both count.
Of the frame only key and text are read, whatever its other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops

WORD_DIMS, CHAR_DIMS = 1 << 13, 1 << 14
DIMS = WORD_DIMS + 2 * CHAR_DIMS
#: Labelled rows of each class that are used, at most; the share of them that is held out for calibration.
SAMPLE_PER_CLASS, HELD_OUT = 1200, 0.25
#: Fixed thresholds on the probability of good quality: from KEEP on a document is kept, under REJECT it is rejected.
KEEP, REJECT = 0.5, 0.2


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the non-zero features, by row and feature."""
    h, at = textops.words(texts, lower=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    rows, cols = [doc], [(h & np.uint64(WORD_DIMS - 1)).astype(np.int64)]
    if len(h) > 1:
        same = np.flatnonzero(doc[1:] == doc[:-1])
        two = textops.mix(h[same] * np.uint64(0x9DDFEA08EB382D69) ^ h[same + 1])
        rows.append(doc[same])
        cols.append((two & np.uint64(WORD_DIMS - 1)).astype(np.int64))
    for i, (buckets, where) in enumerate(textops.char_grams(texts, (3, 4), CHAR_DIMS, letters=False)):
        rows.append(np.repeat(np.arange(len(texts)), np.diff(where)))
        cols.append(buckets + WORD_DIMS + i * CHAR_DIMS)
    out = []
    row, col = np.concatenate(rows), np.concatenate(cols)
    step = max(1, (1 << 21) // DIMS)  # counted in slices of bounded size
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    cut = np.searchsorted(row, np.arange(0, len(texts) + step, step))
    for k in range(len(cut) - 1):
        n = min(step, len(texts) - k * step)
        c = np.bincount((row[cut[k] : cut[k + 1]] - k * step) * DIMS + col[cut[k] : cut[k + 1]], minlength=n * DIMS)
        key = np.flatnonzero(c)
        out.append((key // DIMS + k * step, key % DIMS, np.log1p(c[key])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, f, v = (np.concatenate(x) for x in zip(*out))
    norm = np.sqrt(np.bincount(r, v * v, len(texts)))
    return r, f, v / np.maximum(norm, 1e-12)[r]


def train(r: np.ndarray, f: np.ndarray, v: np.ndarray, good: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights, the bias last; both classes count alike."""
    n = len(good)
    balance = np.where(good > 0, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(r, x[f] * v, n) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = balance * (p - good) / n
        return float((balance * (np.logaddexp(0, z) - good * z)).sum() / n + l2 / 2 * (x[:-1] @ x[:-1])), np.append(np.bincount(f, g[r] * v, DIMS) + l2 * x[:-1], g.sum())

    return common.minimise(loss, np.zeros(DIMS + 1), 150)


def calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(a, b) with P(good) = sigmoid(a z + b); targets are smoothed as Platt does. A falling sigmoid isn't allowed."""
    n1, n0 = good.sum(), (1 - good).sum()
    t = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        y = x[0] * z + x[1]
        p = 1 / (1 + np.exp(-np.clip(y, -40, 40)))
        return float((np.logaddexp(0, y) - t * y).mean()), np.array([((p - t) * z).mean(), (p - t).mean()])

    a, b = common.minimise(loss, np.array([1.0, 0.0]), 100)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_PER_CLASS) -> dict | None:
    """Weights and calibration from at most ``sample`` labelled rows of each class, or None without both classes."""
    some = common.sample_rows(labels.where(F.col("quality").isin(0, 1)).select(key, F.col("quality").cast("int").alias("quality")).distinct(), key, sample, "quality")

    def sparse(texts: list) -> dict:
        r, f, v = features(texts)
        at = np.searchsorted(r, np.arange(len(texts) + 1))
        return {"f": [f[at[i] : at[i + 1]].astype(np.uint16).tobytes() for i in range(len(texts))], "v": [v[at[i] : at[i + 1]].astype(np.float32).tobytes() for i in range(len(texts))]}

    x = common.text_udf("f binary, v binary", sparse)(F.col("__text"))
    slim = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    rows = slim.join(F.broadcast(some), key).select(F.col(key).alias("k"), "quality", x.alias("x")).select("k", "quality", "x.*").collect()
    rows = sorted((r for r in rows if r.f), key=lambda r: (r.k, r.quality))
    good = np.array([r.quality for r in rows], np.float64)
    if len(set(good.tolist())) < 2:
        return None
    n = np.array([len(r.f) // 2 for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    f = np.concatenate([np.frombuffer(r.f, np.uint16) for r in rows]).astype(np.int32)
    v = np.concatenate([np.frombuffer(r.v, np.float32) for r in rows])
    out = textops.mix(np.array([r.k for r in rows], np.int64).view(np.uint64)) % np.uint64(1000) < np.uint64(1000 * HELD_OUT)
    if min(len(set(good[out].tolist())), len(set(good[~out].tolist()))) < 2:
        out = np.zeros(len(rows), bool)
    renumber = np.cumsum(~out) - 1
    use = ~out[row]
    w = train(renumber[row[use]], f[use], v[use], good[~out])
    z = np.bincount(row, w[f] * v, len(rows)) + w[-1]
    held = out if out.any() else ~out
    return {"weights": w.astype(np.float32), "sigmoid": calibrate(z[held], good[held]), "held": (z[held], good[held])}


def scorer(model: dict | None):
    """Column function text -> P(good), null for a text without features."""

    def work(texts: list) -> pa.Array:
        if model is None:
            return pa.array([0.5 if t else None for t in texts], pa.float64())
        w, (a, b) = model["weights"].astype(np.float64), model["sigmoid"]
        r, f, v = features(texts)
        z = np.bincount(r, w[f] * v, len(texts)) + w[-1]
        none = np.bincount(r, minlength=len(texts)) == 0
        return pa.array(1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))), pa.float64(), mask=none)

    return common.text_udf("double", work)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_good, verdict) of every row; the verdict is keep, review or reject."""
    p = scorer(fit(docs, labels))(F.col("text").cast("string"))
    verdict = F.when(F.col("p_good") >= KEEP, "keep").when(F.col("p_good") < REJECT, "reject").otherwise("review")
    return docs.select("doc_id", p.alias("p_good")).select("doc_id", "p_good", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
