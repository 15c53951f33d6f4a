import pytest

from tests.conftest import SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Rows that every operator must bear: nulls, blanks, ties, repeated rows, a long text, clashing columns.
AWKWARD = [
    (1, "one two three", "en", "a", 5, "x"),
    (2, None, "en", "a", None, "y"),
    (3, "", None, None, 0, None),
    (4, " \n\t ", "de", None, 3, "z"),
    (5, "one two three", "en", "b", 5, "x"),
    (5, "one two three", "en", "b", 5, "x"),
    (None, "one two three", "fr", "b", 5, "x"),
    (7, "Wörter und Öl, " * 9000, "de", "c", 9, "x"),
    (8, "a b <|endoftext|> c  d\n\n e", "en", "a", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, component_id string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
