"""Documents with odd rows: nulls, empty and very long texts, ties, repeats, a clashing extra column."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the hunter " * 12
    rows = [
        (1, None, None, None, None, "x"),
        (2, "", "en", "a", 0, "x"),
        (3, " \t\n", "en", "a", 3, "x"),
        (4, base, "en", "a", len(base), "x"),
        (5, base.replace(" ", "  "), "en", "b", 0, "x"),
        (5, base.replace(" ", "  "), "en", "b", 0, "x"),
        (6, base + "x", "en", None, 0, "x"),
        (7, "word " * 60000, "en", "a", 0, "x"),
        (8, "z" * 300000, "en", "b", 0, "x"),
        (9, "naïve café 東京 ΑΣ 😀 <|endoftext|> ² İ", "fr", "b", 0, "x"),
        (None, "no id here", "en", "c", 0, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    """All rows of the given documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, docs.collect()
