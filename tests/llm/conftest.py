import pytest

from kledger.session import ship_code

LONG = "alpha beta gamma delta " * 3000
TEXTS = [
    (0, "The quick brown fox. Jumps over\nthe lazy dog,\nthe lazy dog,\n"), (1, None), (2, ""), (3, "  \t \n "), (4, "The quick brown fox. Jumps over\nthe lazy dog,\nthe lazy dog,\n"),
    (5, "Émentréç où leç de, naïve ﬁ İ Σίσυφος ẖ H̱ 12 it's"), (6, LONG), (7, "x" * 5000), (8, "a"), (9, "one two three four five six seven eight"), (None, "no id here"), (9, "one two three four five six seven eight"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank, long, repeated rows, a null id, and columns whose names the operators use themselves."""
    ship_code(spark)
    rows = [(i, t, "en", None, None, 1, "r", 0, False, 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, record string, bucket int, kept boolean, length int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (6, 0, 0), (5, 1, 1), (None, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
