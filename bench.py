"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query computes all its rows and columns into a no-op sink.  Each is run
three times in one session and the fastest run counts, so that JVM start-up and
code generation are left out; ``first_run`` holds the first timings.

The given ``documents`` table is one file of one row group, which a single task
would read.  It is written again before any timing, unchanged but in as many
files as there are cores; the other tables are used where they are.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from catalog import queries as registered
from catalog import views
from packlake.functions import shape, tokens
from packlake.operators import scan
from packlake.plans import pack, render, store
from packlake.session import build
from packlake.sources import tables
from packlake.spec import PackSpec

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STORES: list[str] = []
REGISTERED = [
    "flagship_budget_hogs",
    "p1_redact",
    "p3_tokens_pretoken",
    "f3_rule_cascade",
    "a2_directory_rollup",
    "a5_churn",
    "w1_token_budget",
    "w5_output_ordinal",
    "j10_snapshot_diff",
]


def files(spark):
    return tables.files(spark, SF_DIR).drop("doc_id")


def full_pack(spark):
    """Scan, rules, redaction, tokens and a markdown document of every pack, in document order."""
    return render.ordered(pack.pack(files(spark), PackSpec(collation=views.BINARY)))


def budget_pack(spark):
    spec = PackSpec(collation=views.BINARY, max_tokens=150_000)
    return render.sections(pack.pack(files(spark), spec))


def scan_phase(spark):
    return scan.add_flags(scan.kept(scan.select_files(files(spark), PackSpec())))


def compress(spark):
    """Signature skeletons and their token counts over all files shaped like source code."""
    sources = tables.source_like(spark, SF_DIR).unionByName(tables.brace_source_like(spark, SF_DIR))
    skeleton = shape.signatures(F.col("path"), F.col("content"))
    return sources.select("pack_id", "path", tokens.count_tokens(skeleton).alias("tokens"))


def store_save(spark):
    """Write the stored pack: numbered lines, sorted; the folder is new each time."""
    folder = tempfile.mkdtemp(prefix="packlake-bench-")
    store.save(pack.pack(files(spark), PackSpec(collation=views.BINARY)), folder)
    STORES.append(folder)
    return spark.read.parquet(f"{folder}/packs")


def store_grep(spark):
    _, lines = store.load(spark, STORES[-1])
    return store.grep_text(store.grep(lines, "(?:token|license)", ignore_case=True, context=2), 2)


def store_page(spark):
    return store.read_page(*store.load(spark, STORES[-1]), 1001, 500)


def spread_input(spark) -> None:
    """From now on ``SF_DIR`` is a folder with the same tables, documents in several files."""
    global SF_DIR
    folder = tempfile.mkdtemp(prefix="packlake-bench-input-")
    for name in os.listdir(SF_DIR):
        if name != "documents.parquet":
            os.symlink(os.path.join(os.path.abspath(SF_DIR), name), os.path.join(folder, name))
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(int(CPUS)).write.parquet(f"{folder}/documents.parquet")
    SF_DIR = folder


def main() -> None:
    spark = build(
        app="packlake-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    spread_input(spark)
    todo = {f.__name__: f for f in (full_pack, budget_pack, scan_phase, compress, store_save, store_grep, store_page)}
    for name in REGISTERED:
        todo[name] = lambda s, q=registered.QUERIES[name]: q(s, SF_DIR)
    first, best = {}, {}
    for name, query in todo.items():
        for _ in range(3):
            start = time.perf_counter()
            query(spark).write.format("noop").mode("overwrite").save()
            seconds = round(time.perf_counter() - start, 3)
            first.setdefault(name, seconds)
            best[name] = min(seconds, best.get(name, seconds))
    n = files(spark).count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "sf": scale,
                "first_run": first,
                "files": n,
                "full_pack_files_per_second": round(n / best["full_pack"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
