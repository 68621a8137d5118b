"""Tokeniser: lower case, then maximal runs of letters and digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """Array of tokens; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def query_tokens(text: str) -> list[str]:
    """The same on the driver, for a query text."""
    return [w for run in re.findall(r"[^\W_]+", text.lower()) for w in [run] if w]
