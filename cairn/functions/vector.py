"""Vector arithmetic: Column expressions in double precision, and a NumPy kernel for Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.model import Metric

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero. The norm stands outside the lambda, so it is computed once a row."""
    return F.zip_with(doubles(a), F.array_repeat(F.greatest(norm(a), F.lit(EPS)), F.size(a)), lambda x, n: x / n)


def distance(metric: Metric, a: Column, b: Column) -> Column:
    """Ordering distance, lower is better: 1 - cosine, minus dot, squared L2."""
    return {Metric.COSINE: lambda: 1 - cosine(a, b), Metric.DOT: lambda: -dot(a, b), Metric.L2: lambda: l2_squared(a, b)}[Metric.parse(metric)]()


def score_of(metric: Metric, d: Column) -> Column:
    """The user's score of an ordering distance."""
    return {Metric.COSINE: 1 - d, Metric.DOT: -d, Metric.L2: F.sqrt(F.greatest(d, F.lit(0.0)))}[Metric.parse(metric)]


def distance_of(metric: Metric, score: Column) -> Column:
    """The ordering distance of a user's score."""
    return {Metric.COSINE: 1 - score, Metric.DOT: -score, Metric.L2: score * score}[Metric.parse(metric)]


def score(metric: Metric, a: Column, b: Column) -> Column:
    return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.L2: l2}[Metric.parse(metric)](a, b)


def finite(v: Column, dimension: int) -> Column:
    """Whether the array has that many numbers, all finite."""
    return (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scores(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All scores of the rows of q against the rows of x, in double precision."""
    if metric is Metric.COSINE:
        q = q / np.maximum(np.linalg.norm(q, axis=1), EPS)[:, None]
        x = x / np.maximum(np.linalg.norm(x, axis=1), EPS)[:, None]
    s = q @ x.T
    if metric is Metric.L2:
        s = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * s + (x * x).sum(1), 0))
    return s
