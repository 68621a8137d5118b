"""Metadata filters: a mapping of keys to a value (equality) or a list (any of); keys are joined by AND."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _equals(c: Column, value: Any) -> Column:
    if value is None:
        return c.isNull()
    return F.coalesce(c == F.lit(value), F.lit(False))


def matches(column: Column, expected: Any) -> Column:
    """One key. A missing key is null; null matches missing and null; an empty list matches nothing."""
    values = list(expected) if isinstance(expected, (list, tuple, set, frozenset)) else [expected]
    out = F.lit(False)
    for v in values:
        out = out | _equals(column, v)
    return out


def on_columns(criteria: dict[str, Any] | None) -> Column:
    """A filter over typed metadata columns."""
    out = F.lit(True)
    for key, expected in (criteria or {}).items():
        out = out & matches(F.col(key), expected)
    return out


def _variant(metadata: Column, key: str, value: Any) -> Column:
    v = F.try_variant_get(metadata, "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
    kind = F.schema_of_variant(v)
    null = v.isNull() | F.is_variant_null(v)
    if value is None:
        return F.coalesce(null, F.lit(True))
    if isinstance(value, (bool, int, float)):  # 1 == 1.0 == True
        same = F.try_variant_get(v, "$", "double") == F.lit(float(value))
        return F.coalesce(~null & ~kind.isin("STRING") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & same, F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(value))), F.lit(False))


def on_json(metadata: Column, criteria: dict[str, Any] | None) -> Column:
    """A filter over a column of JSON text."""
    v, out = F.try_parse_json(metadata), F.lit(True)
    for key, expected in (criteria or {}).items():
        values = list(expected) if isinstance(expected, (list, tuple, set, frozenset)) else [expected]
        one = F.lit(False)
        for x in values:
            one = one | _variant(v, key, x)
        out = out & one
    return out
