import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
#: doc_id, text, lang, source, n_chars: nulls in every column, empty, blank and very long texts, equal rows and equal ids.
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57), (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \t\n ", "fr", None, 4), (None, "a text without an id", "en", "c", 20), (6, "un deux trois quatre cinq six sept huit", "fr", "c", 39),
    (7, LONG, "en", "a", len(LONG)), (8, LONG, None, "a", None), (9, "12345 67890 !!!", "en", None, 15), (9, "12345 67890 !!!", "en", None, 15), (10, "one  two   three\x00<|endoftext|> 你好 café \U0001f600", "en", "b", 40),
    (11, "the quick brown fox jumps over the lazy dog and runs home", "en", "b", 57), (12, "AA" * 300, "en", "b", 600), (13, "word", "fr", "b", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGES, SCHEMA)
    for c in ("score", "node", "_text", "size", "kept", "_key", "_row", "begins", "lang_pred", "piece"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
