"""Metrics, index kinds, schemas and typed errors of the engine."""

from __future__ import annotations

import enum

from pyspark.sql import types as T


class _Named(str, enum.Enum):
    @classmethod
    def parse(cls, value):
        """The member of that name in any case; anything else is an error of the engine."""
        try:
            return value if isinstance(value, cls) else cls(str(value).strip().lower())
        except ValueError:
            raise cls._error()(f"{value!r} is none of {', '.join(m.value for m in cls)}") from None


class Metric(_Named):
    COSINE = "cosine"
    DOT = "dot"
    L2 = "l2"

    @staticmethod
    def _error():
        return InvalidMetric

    @property
    def ascending(self) -> bool:
        """Whether the user's score is better when lower."""
        return self is Metric.L2


class IndexType(_Named):
    FLAT = "flat"
    IVF = "ivf"
    HNSW = "hnsw"

    @staticmethod
    def _error():
        return InvalidIndexType


class EngineError(Exception):
    code, status = "internal", 500


def _error(name: str, code: str, status: int) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "status": status, "__module__": __name__})


DimensionMismatch = _error("DimensionMismatch", "dimension_mismatch", 400)
InvalidMetric = _error("InvalidMetric", "invalid_metric", 400)
InvalidIndexType = _error("InvalidIndexType", "invalid_index_type", 400)
InvalidRequest = _error("InvalidRequest", "invalid_request", 400)
CollectionNotFound = _error("CollectionNotFound", "collection_not_found", 404)
IdNotFound = _error("IdNotFound", "id_not_found", 404)
CollectionExists = _error("CollectionExists", "collection_exists", 409)
IdExists = _error("IdExists", "id_exists", 409)
BatchTooLarge = _error("BatchTooLarge", "batch_too_large", 413)
NoTextField = _error("NoTextField", "no_text_field", 400)
Conflict = _error("Conflict", "conflict", 409)
CorruptData = _error("CorruptData", "corrupt_data", 500)

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType())])


def fetch_size(k: int, filtered: bool) -> int:
    """Candidates to retrieve for k results: more of them if a metadata filter follows."""
    return min(max(10 * k, 100), 1000) if filtered else k
