import pytest

LONG = "lorem ipsum dolor " * 20_000

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 0),
    (2, "The quick brown fox  jumps over\tthe lazy dog near the river bank today", "en", "a", 0),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, "   ", "de", "b", 3),
    (6, "one", "de", "b", 3),
    (7, LONG, "fr", "c", len(LONG)),
    (8, LONG, "fr", None, len(LONG)),
    (9, "Größe — ünïcode テスト 🎉 text with A b C", "de", "c", 0),
    (9, "Größe — ünïcode テスト 🎉 text with A b C", "de", "c", 0),
    (10, "The quick brown fox jumps over the lazy dog near the river bank tonight", "en", "a", 0),
    (11, "\x1c strange\x85separators and\x0bspaces\x0cin\rhere", "es", "a", 0),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, long and repeated texts, ties, and an extra column whose name an operator might use."""
    return spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, lang string, source string, n_chars long, count string")


@pytest.fixture(scope="session")
def corpus(spark, docs, tmp_path_factory):
    """A folder with the tables of those documents, and one with an empty table."""
    full, empty = str(tmp_path_factory.mktemp("full")), str(tmp_path_factory.mktemp("empty"))
    docs.write.mode("overwrite").parquet(f"{full}/documents.parquet")
    docs.limit(0).write.mode("overwrite").parquet(f"{empty}/documents.parquet")
    return full, empty
