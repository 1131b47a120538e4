"""Complete packs on a stream of files (budget W1, roll-up A2 and totals of packs as they close).

Files arrive in any number of micro-batches; a row with a null path says that its
pack is complete.  A pack's files are not held in a state store, where one hot
pack would be one key: every batch appends narrow facts to a table, and when a
pack closes, its facts are read back and go through the same distributed plan as
a batch run.

Tables below the output folder, all partitioned by ``batch``:

* ``facts``: a row per file that arrived, also by ``slot`` (a hash of the pack), so that closing reads few folders;
* ``stats``, ``directories``, ``totals``: results of the packs that closed in the batch;
* ``closed``: these packs; written last, and results count from then on (:func:`results`).

A batch writes only its own partitions and overwrites them when it is run again,
and it does not look at later ones, so results are the same after a failure.

Defined cases: a file that arrives again replaces the earlier one (in one batch,
the larger, then the larger hash); a pack may close again after more files, and
its latest results count; a pack without files closes with no results; rows
without a pack are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from packlake import fixed
from packlake.functions import paths
from packlake.operators import rollup
from packlake.plans import pack
from packlake.session import materialize
from packlake.sources import corpus
from packlake.spec import PackSpec

SLOTS = 16
RESULTS = ("stats", "directories", "totals")


def _arrived(files: DataFrame, spec: PackSpec) -> DataFrame:
    """Facts of a batch; rule files keep their text, because they decide about other files."""
    if "raw" in files.columns:
        files = files.withColumn("content", corpus.decode())
    files = files.filter("pack_id IS NOT NULL")
    rules = F.col("path").isin(fixed.ROOT_RULE_FILES) | (paths.basename(F.col("path")) == F.lit(fixed.NESTED_RULE_FILE))
    kept = {
        "rules": F.when(rules, F.col("content")),
        "digest": F.xxhash64("content"),
        "slot": F.pmod(F.xxhash64("pack_id"), F.lit(SLOTS)).cast("int"),
    }
    return pack.facts(files.withColumns(kept), spec, tuple(kept))


def _latest(rows: DataFrame) -> DataFrame:
    """The last arrival of every file; keys are unique files, so no pack is a hot key."""
    fields = [c for c in rows.columns if c not in ("pack_id", "path")]
    last = F.max_by(F.struct(*fields), F.struct("batch", "size_bytes", "digest"))
    return rows.groupBy("pack_id", "path").agg(last.alias("f")).select("pack_id", "path", "f.*")


def _close(spark: SparkSession, spec: PackSpec, path: str, batch: int, schema: StructType) -> None:
    """Write the results of the packs that this batch closes; ``schema`` is that of the facts table."""
    facts = spark.read.schema(schema).parquet(f"{path}/facts").filter(F.col("batch") <= batch)
    marks = facts.filter((F.col("batch") == batch) & F.col("path").isNull())
    closing = materialize(marks.select("pack_id", "slot").distinct())
    slots = [r.slot for r in closing.select("slot").distinct().collect()]  # at most SLOTS
    if slots:
        here = facts.filter(F.col("slot").isin(slots) & F.col("path").isNotNull())
        known = materialize(_latest(here.join(closing.select("pack_id"), "pack_id", "left_semi")))
        rules = known.select("pack_id", "path", "size_bytes", F.col("rules").alias("content"))
        plan = pack.pack(rules, spec, known=known.drop("rules", "digest", "slot", "batch"))
        tables = {"stats": plan.stats, "directories": rollup.directory_tokens(plan.stats), "totals": plan.totals}
        for name in RESULTS:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        closing.select("pack_id").write.mode("overwrite").parquet(f"{path}/closed/batch={batch}")


def pack_stream(files: DataFrame, spec: PackSpec, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that plans every pack of a stream of files once it is complete.

    ``files`` has the columns of :func:`packlake.plans.pack.pack`.  The default
    trigger processes what has arrived and stops.
    """
    if spec.token_mode == "bpe" or spec.changed_only or spec.sort == "churn" or spec.scan_paths:
        raise ValueError("a stream has no rank table, change set, history or scan paths")

    def each(rows: DataFrame, batch: int) -> None:
        arrived = _arrived(rows, spec)
        arrived.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/facts/batch={batch}")
        _close(rows.sparkSession, spec, path, batch, StructType([*arrived.schema.fields]).add("batch", "integer"))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one of ``RESULTS`` for every closed pack, as of its latest closing."""
    closed = spark.read.parquet(f"{path}/closed").groupBy("pack_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/{name}").join(closed, ["pack_id", "batch"], "left_semi").drop("batch")
