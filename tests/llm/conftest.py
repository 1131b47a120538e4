import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", extra) if extra else df

    return make


CLASHING = "1 AS id, 2 AS tie, 3 AS size, 4 AS key, 5 AS n, 6 AS _row, 7 AS score, 8 AS seg, 9 AS d, 10 AS component"


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns named as the operators name their own."""

    def make(rows):
        return documents(rows).selectExpr("*", *CLASHING.split(", "))

    return make
