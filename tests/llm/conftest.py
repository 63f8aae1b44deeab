import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, an extra column with a clashing name."""
    rows = [
        (1, "the cat sat on the mat\n" * 40, "en", "a", 5, 1),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, 2),
        (None, "lonely words here", None, "b", 3, 3),
        (4, "the cat sat on the mat\n" * 40, "en", "b", 5, 4),
        (4, "the cat sat on the mat\n" * 40, "en", "b", 5, 4),
        (5, "ünï çødé 中文字 🙂 it's  we'll\t\n x" * 30, "de", None, 1, 5),
        (6, "a" * 5000 + " tail", "xx", "c", 1, 6),
        (7, " \n ", "en", "a", 3, 7),
        (8, "y", "en", "a", 1, 8),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
