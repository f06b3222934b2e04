import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 3, "x", 0.5, 7, "r"),
        (1, "alpha beta gamma delta epsilon", "en", "a", 3, "x", 0.5, 7, "r"),
        (2, None, None, None, None, None, None, None, None),
        (None, "alpha beta gamma delta epsilon", "en", None, 3, "x", 0.5, 7, "r"),
        (3, "", "", "", 0, "", 0.0, 0, ""),
        (4, " \n\t ", "de", "b", 4, "y", 0.1, 1, "s"),
        (5, LONG, "en", "b", len(LONG), "z", 0.2, 2, "t"),
        (6, "Ünïcödé — 漢字 ok\nline two", "fr", "c", 9, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, n_words long, text_hash string")


@pytest.fixture
def empty(odd):
    return odd.limit(0)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
