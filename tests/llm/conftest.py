import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text, source) rows as a documents table, with columns of other names beside it."""

    def make(rows, **extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls, empty and blank texts, repeated rows, a long one.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "no id here"), (5, "word " * 30_000), (6, "é漢😀 x")]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
