import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns named like inner ones."""
    rows = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "a"), (5, "Apache License here"), (5, "Apache License here"), (6, "word " * 30_000), (7, "x" * 20_000),
        (8, "naïve çà été 日本語 😀 " * 50), (None, "no id at all, but a text"), (9, "one two three\none two three\none two three"), (10, "a b"), (11, "the end " + "z" * 70),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, "f", "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
