from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic string, words int, id string, f string, x string, quality string, k string, `__position` string, position string, row string, `__f` string, sig string, size int, n int, h string, node string, `__text` string, `__l` string, `__t` string"


@pytest.fixture(scope="session")
def odd(spark, sf_dir):
    """Rows that no operator may fail on, with columns whose names clash with the operators' own."""
    long = "word soup and more of it " * 40_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, long, "en", "a", len(long)), (5, "Same text here, twice over.", "en", "a", 27), (6, "Same text here, twice over.", "en", None, 27),
        (7, "Same text here, twice over.", "en", "b", None), (None, "Same text here, twice over.", "en", "b", 1), (8, "x", "en", "b", 1), (9, "☃ 🎉 日本語 é \x00 ​", None, "b", 9), (5, "Same text here, twice over.", "en", "a", 27),
    ]
    rows.append((10, "A" * 30_000 + " STOP" * 4_000 + "!", "en", "b", 50_001))
    rows = [tuple(r) + ("t", 1, "i", "f", "x", "q", "k", "p", "p", "r", "f", "s", 1, 1, "h", "n", "t", "l", "t") for r in rows]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
