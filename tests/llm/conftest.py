import pytest

#: Null, empty, repeated rows and ids, white space only, one long word, control strings.
ODD = [
    (1, "alpha beta gamma delta", "en", "a"),
    (1, "alpha beta gamma delta", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", None, "b"),
    (None, "alpha beta gamma delta", "en", None),
    (5, "x" * 5000, "en", "b"),
    (6, "alpha beta gamma delta", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows, and columns named like those that the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "char_length(text) AS n_chars", "1 AS key", "2 AS h", "'x' AS label", "3 AS slice", "4 AS kind", "5 AS size")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
