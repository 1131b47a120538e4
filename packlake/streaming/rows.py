"""Row-local steps over a stream of files.

Shaping, redaction and counting look at one file at a time, so the batch
expressions run on a streaming DataFrame unchanged and need no state.  Whatever
needs a complete pack (budget, order, roll-up) reads the table written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from packlake.plans.pack import facts
from packlake.spec import PackSpec


def append_facts(files: DataFrame, spec: PackSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of every arriving file to a parquet table, exactly once.

    Processes what has arrived and stops.
    """
    return (
        facts(files, spec)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
