import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, copies string, block string, __text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = "the cat and the dog sat on a mat. " * 20000
    texts = [(1, "The cat sat.\nReleased under the MIT License.", "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (None, "no id here", "en"), (6, "Der Hund läuft.", "de"), (6, "Der Hund läuft.", "de"), (8, " \n\t ", "fr"), (9, "12345 !!", None), (10, "日本語 テキスト", None)]
    return spark.createDataFrame([(i, t, l, None if (i or 0) % 2 else "web", None, None, "x", None, "b", "c") for i, t, l in texts], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, None), (6, None, 1), (6, 0, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
