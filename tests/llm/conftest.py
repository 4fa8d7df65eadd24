import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, label string, sid long, bucket int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns that clash with internal names."""
    long = " ".join(f"Word{i % 977} tail{i % 31}" for i in range(4000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36, 5, "x", 1, 1),
        (2, "ALPHA beta gamma delta epsilon zeta.", "en", "a", 36, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 5, "x", 1, 1),
        (5, long, "en", "b", len(long), 5, "y", 2, 2),
        (6, long + " end", None, "b", None, 5, "y", 2, 2),
        (7, "ÀÉÎ straße 東京 🙂 it's we're  two\n\nlines\t.", "fr", "c", 40, 6, "z", 3, 3),
        (7, "ÀÉÎ straße 東京 🙂 it's we're  two\n\nlines\t.", "fr", "c", 40, 6, "z", 3, 3),
        (None, "orphan text without an id", "de", "c", 25, 7, "z", 3, 3),
        (9, "  \n ", "es", "d", 4, 7, "z", 3, 3),
        (10, "!!! 123 ???", "es", "d", 11, 7, "z", 3, 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
