import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples, with columns that clash with results."""

    def make(rows):
        rows = [(*r, *[None] * (5 - len(r)), 1, "x") for r in rows]
        return spark.createDataFrame(rows, DOCS + ", kept int, component_id string")

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "ONE two three"), (7, "one two three"),
    (8, "é È ñ 中文   x y"), (9, "word " * 30000), (10, "word " * 30000), (11, "\x00\x01 ~!@#"), (None, "one"), (None, None),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD_ROWS)
