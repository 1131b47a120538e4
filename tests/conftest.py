import pytest

from packlake.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(
        app="packlake-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Build a files table from {path: text} or {(pack, path): text}."""

    def make(files):
        rows = []
        for key, content in files.items():
            pack_id, path = key if isinstance(key, tuple) else ("p", key)
            size = len(content.encode()) if content is not None else 0
            rows.append((pack_id, path, size, content))
        return spark.createDataFrame(rows, "pack_id string, path string, size_bytes bigint, content string")

    return make


@pytest.fixture
def evaluate(spark):
    """Value of a column function over literal strings."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return row.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v

    return run
