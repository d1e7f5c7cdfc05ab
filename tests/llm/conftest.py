import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_tokens long, doc string, h string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    long = "needle in a very long text that goes on and on\n" + "word " * 60_000 + "\nthe last line of the long text"
    rows = [
        (1, "One shared line of text here\nown line of the first document", "en", "a", 1, True, 0.5, 3, "x", "y"),
        (2, "  one SHARED line of text here\t\nanother own line, of the second", "en", "a", 1, None, None, None, None, None),
        (3, "", "de", None, 0, True, 0.5, 3, "x", "y"),
        (4, None, None, "b", None, True, 0.5, 3, "x", "y"),
        (5, " \n\t ", "fr", "b", 3, True, 0.5, 3, "x", "y"),
        (6, long, "en", "b", len(long), True, 0.5, 3, "x", "y"),
        (7, long, "en", "b", len(long), True, 0.5, 3, "x", "y"),
        (7, long, "en", "b", len(long), True, 0.5, 3, "x", "y"),
        (8, "a b c", "en", "c", 5, True, 0.5, 3, "x", "y"),
        (9, "A  B\nc", "en", "c", 6, True, 0.5, 3, "x", "y"),
        (None, "One shared line of text here", "en", "c", 28, True, 0.5, 3, "x", "y"),
        (None, None, None, None, None, None, None, None, None, None),
        (10, "12345 67890 !!! ...", "en", "c", 19, True, 0.5, 3, "x", "y"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
