import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, S string, kept boolean"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here"), (5, "same row"), (5, "same row"),
        (6, "word " * 6000), (7, "é" * 300), (8, "a\x1cb <|endoftext|> It's DON'T ΑΣ x\x85y")]


def rows(pairs):
    return [(i, t, "en", "src", len(t or ""), 7, "clash", None) for i, t in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, very long and repeated texts, and columns with clashing names."""
    return spark.createDataFrame(rows(EDGE), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def given(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
