import pytest

#: Texts that every operator on documents must take: null, empty, white space, ties, repeats, long.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n\v\f\r "),
    (4, "one"),
    (4, "one"),
    (5, "a b c d e f g h i j k l"),
    (6, "a b  c d\ne f g h i j k l"),
    (7, "word " * 60_000),
    (8, "x" * 300_000),
    (None, "no name"),
    (9, "Ünïcode ß 漢字     \U0001f600 \x00 end"),
    (10, "1" * 50_000 + "." + "2" * 50_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, at string, kept string"


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases with further columns, some of whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "d", "a", "k") for i, t in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    """A part of the generated documents, enough for brute force."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
