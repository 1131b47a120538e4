"""Command line: compare registered queries with their SQL twins.

    python -m tests.check_catalog /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

from packlake.session import build
from tests.oracle import compare, connect, type_differences


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    spark = build(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                kinds = type_differences(df, con, sql[name])
                if kinds:
                    print("    types differ:", name, kinds, flush=True)
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        label = "ok" if problem is None else "BAD"
        print(f"{label:4}{name:32}{time.time() - start:6.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
