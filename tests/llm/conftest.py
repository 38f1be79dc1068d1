import pyarrow.dataset as ds
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def small_filters(spark):
    spark.conf.set("spark.tablesmith.filterBits", str(1 << 14))


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the small table."""
    t = ds.dataset(f"{SMALL}/documents.parquet").to_table(columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, LONG), (7, LONG), (8, "ß É " * 70), (9, "x"),
    (None, "a null id with some words in it"), (10, "token = abcdef0123456789abcdef0123456789\nAll rights reserved.\nAll rights reserved."), (11, "same line\nsame line\n\n\nsame line "), (12, "a " * 300),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, ties, repeated rows, a long text, and columns with names that the operators use themselves."""
    rows = [(i, t, None if i == 4 else "en", "s", len(t or ""), 1, "k", 0, 1, "x", "y", "z") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key int, _text_key string, part int, n int, component string, _key string, spans string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
