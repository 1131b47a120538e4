"""The whole packing plan: select, shape, redact, count, budget.

One pass over the text derives narrow facts (flags, token counts, technologies)
row by row, without a shuffle of text.  Everything that selects, orders, sums or
cuts a pack works on those facts, which are written once.  Text is read again
only to be rendered, and then meets its facts on the unique (pack_id, path) key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import redact as secrets
from packlake.functions import shape as shaping
from packlake.functions import paths, text, tokens
from packlake.operators import bpe, budget, history, order, rollup, scan, stack
from packlake.session import materialize
from packlake.sources import corpus
from packlake.spec import PackSpec


def shaped(files: DataFrame, spec: PackSpec) -> DataFrame:
    """Shape text of files that have any (P17); with its lengths before and after, and whether a skeleton is shown."""
    if not spec.shapes:
        return files
    path, content, has = F.col("path"), F.col("content"), scan.has_content()
    skeleton = shaping.signatures(path, content) if spec.compress else F.lit(None).cast("string")
    rest = shaping.shape(path, content, comments=spec.remove_comments, blank_lines=spec.remove_blank_lines)
    made = files.withColumn("_skeleton", F.when(has, skeleton))
    made = made.withColumn("_shaped", F.when(has, F.coalesce("_skeleton", rest)))
    return made.withColumns(
        {
            "chars_before": F.when(has, F.char_length(content).cast("bigint")),
            "chars_after": F.char_length("_shaped").cast("bigint"),
            "is_compressed": F.col("_skeleton").isNotNull(),
            "content": F.coalesce("_shaped", content),
        }
    ).drop("_skeleton", "_shaped")


def counted(files: DataFrame, spec: PackSpec) -> DataFrame:
    """Shape, then redact, then count (A1): no line numbers, headers or tree."""
    out = shaped(files, spec).withColumn("has_content", scan.has_content())
    if spec.redact:
        out = secrets.redact(out)
        out = out.withColumn(
            "redactions", F.when(F.col("has_content"), F.col("redactions")).otherwise(F.lit(0).cast("bigint"))
        )
    else:
        out = out.withColumn("redactions", F.lit(0).cast("bigint"))
    if spec.token_mode == "bpe":  # counted apart, see _with_bpe
        return out.withColumn("tokens", F.lit(0).cast("bigint"))
    return out.withColumn(
        "tokens",
        F.when(
            F.col("has_content"), tokens.count_tokens(F.col("content"), spec.token_mode)
        ).otherwise(F.lit(0).cast("bigint")),
    )


def body_facts(spec: PackSpec) -> dict[str, Column]:
    """What a document needs to know of a finished body to place it: its lines, its bytes as written, its fence.

    Numbers before lines add their width to every line and change nothing else.
    """
    content = F.col("content")
    lines = text.line_count(content)
    written = {"xml": text.xml_escape, "json": text.json_string}.get(spec.format, lambda body: body)(content)
    size = F.octet_length(written).cast("bigint") - (2 if spec.format == "json" else 0)
    if spec.line_numbers:
        # in JSON a line feed is written as two letters and separates lines just the same
        size = size + lines * (F.length(lines.cast("string")) + 2)
    found = {
        "body_lines": F.lit(1).cast("bigint") if spec.format == "json" else lines,
        "body_bytes": size,
        "fence": text.fence_for(content) if spec.format == "markdown" else F.lit(None).cast("string"),
    }
    return {name: F.when(F.col("has_content"), fact) for name, fact in found.items()}


BODY_FACTS = ["body_lines", "body_bytes", "fence"]
SHAPING_FACTS = ["chars_before", "chars_after", "is_compressed"]  # of specs that shape


def facts(files: DataFrame, spec: PackSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """Narrow facts of every file, and ``carry`` columns as they are; row-local, so the text is never shuffled."""
    keep = ["pack_id", "path", "size_bytes", "is_binary", "is_oversized", "has_content", "redactions", "tokens"]
    flagged = scan.add_flags(files, spec.max_file_bytes)
    techs = stack.file_technologies(F.col("path"), F.col("content"))
    made = counted(flagged.withColumn("techs", techs), spec).withColumns(body_facts(spec))
    return made.select(*keep, "techs", *BODY_FACTS, *(SHAPING_FACTS if spec.shapes else []), *carry)


def _with_bpe(files: DataFrame, narrow: DataFrame, spec: PackSpec, ranks: DataFrame, pieces_path: str | None) -> DataFrame:
    """Exact token counts of the shaped, redacted text in place of the estimate."""
    estimated = replace(spec, token_mode="pretoken")
    texts = counted(scan.add_flags(files, spec.max_file_bytes), estimated).filter("has_content")
    exact = bpe.count_bpe(texts.select("pack_id", "path", "content"), ranks, spec.encoding, pieces_path=pieces_path)
    return (
        narrow.drop("tokens")
        .join(exact, ["pack_id", "path"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    )


@dataclass
class Pack:
    """Result of :func:`pack`: tables keyed by pack_id.

    ``stats`` and ``totals`` are narrow and written; ``text`` is lazy.
    """

    spec: PackSpec
    source: DataFrame
    selection: DataFrame  # every scanned path with its selection flags
    stats: DataFrame  # one row per packed file
    totals: DataFrame  # one row per pack
    log: DataFrame | None = None
    diffs: DataFrame | None = None
    packs: DataFrame | None = None

    @property
    def files(self) -> DataFrame:
        """Packed files with their final text; null text where none is inlined."""
        return self.with_text(self.stats)

    def with_text(self, stats: DataFrame) -> DataFrame:
        """Rows of ``stats``, or of a table made from it by adding columns, with their final text; one join."""
        shown = stats.drop("techs", "redactions", "tokens_before", "is_candidate", "is_selected", "is_suspicious", *SHAPING_FACTS)
        # only text that can be inlined is moved: excluded, binary and oversized files stay behind
        flagged = scan.add_flags(self.source.filter(scan.reachable(self.spec)), self.spec.max_file_bytes)
        body = flagged.filter(scan.has_content()).select("pack_id", "path", "content")
        final = shaped(body.join(shown.filter("has_content"), ["pack_id", "path"]), self.spec).drop(*SHAPING_FACTS)
        if self.spec.redact:
            final = final.withColumn("content", secrets.redacted(F.col("content")))
        bare = shown.filter("NOT has_content").withColumn("content", F.lit(None).cast("string"))
        return final.unionByName(bare)

    @property
    def omitted(self) -> DataFrame:
        """Paths dropped for the budget (Q4)."""
        return self.stats.filter("is_omitted").select("pack_id", "path", "tokens_before")

    @property
    def suspicious(self) -> DataFrame:
        """Credential-shaped files left out."""
        return scan.suspicious(self.selection)

    @property
    def savings(self) -> DataFrame:
        """What shaping saved per pack, files dropped for the budget included (A8, P24); no row unless the spec shapes."""
        if not self.spec.shapes:
            bare = self.stats.limit(0).select("pack_id", *[F.lit(None).cast("bigint").alias(c) for c in SHAPING_FACTS[:2]], F.lit(False).alias("is_compressed"))
            return rollup.shaping_savings(bare)
        return rollup.shaping_savings(self.stats)

    @property
    def prune(self) -> DataFrame:
        """Prune counts."""
        return scan.prune_counts(self.selection)

    def order_keys(self):
        return order.order_keys(self.spec.sort, self.spec.collation)


def pack(
    files: DataFrame,
    spec: PackSpec,
    touches: DataFrame | None = None,
    commits: DataFrame | None = None,
    changed: DataFrame | None = None,
    diffs: DataFrame | None = None,
    ranks: DataFrame | None = None,
    known: DataFrame | None = None,
    pieces_path: str | None = None,
    packs: DataFrame | None = None,
) -> Pack:
    """Plan a run over a ``files`` table (pack_id, path, size_bytes, content or raw).

    (pack_id, path) is unique.  ``diffs`` holds diff text (pack_id, diff), in any
    number of rows per pack if columns ``path`` and ``part`` order them; ``packs``
    (unique pack_id) may give packs their own ``persona``, ``recipe`` and ``task``,
    where a null leaves the spec's.  ``ranks`` is the rank table of the ``bpe``
    token mode and ``pieces_path`` a folder that keeps its merged pieces between
    runs.  ``known`` are :func:`facts` made before; then ``files`` needs the text
    of rule files only, unless texts are rendered.
    """
    require_choices(packs)
    if spec.token_mode == "bpe" and ranks is None and known is None:
        raise ValueError("token mode bpe needs a rank table")
    if spec.changed_only and changed is None:
        raise ValueError("changed_only needs a table of changed paths")
    if spec.sort == "churn" and touches is None:
        raise ValueError("sorting by churn needs a table of touches")

    scan.require_scan_paths(files, spec.scan_paths)
    if "raw" in files.columns:
        files = files.withColumn("content", corpus.decode())
    reached = files.filter(scan.reachable(spec))  # a path test, so text of excluded files is not even read
    narrow = facts(reached, spec) if known is None else known
    if spec.token_mode == "bpe" and known is None:
        narrow = _with_bpe(reached, narrow, spec, ranks, pieces_path)
    selection = materialize(scan.select_files(files, spec, narrow))
    stats = scan.kept(selection)
    if spec.changed_only:
        stats = history.only_changed(stats, changed)
    if spec.sort == "churn":
        stats = history.with_churn(stats, history.churn(touches, spec.churn_commits))
    if spec.changed_only or spec.sort == "churn":
        stats = materialize(stats)

    stats = stats.withColumn("tokens_before", F.col("tokens"))
    if spec.max_tokens is None:
        stats = stats.withColumn("is_omitted", F.lit(False))
    else:
        keys = order.order_keys(spec.sort, spec.collation)
        stats = budget.mark_omitted(stats, spec.max_tokens, keys)
        gone, none = F.col("is_omitted"), F.lit(0).cast("bigint")
        manifest = paths.basename(F.col("path")) == F.lit(fixed.MANIFEST)
        stats = materialize(
            stats.withColumn("tokens", F.when(gone, none).otherwise(F.col("tokens")))
            .withColumn("redactions", F.when(gone, none).otherwise(F.col("redactions")))
            .withColumn("has_content", F.col("has_content") & ~gone)
            .withColumn("techs", F.when(~(gone & manifest), F.col("techs")))
        )
    totals = stats.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("tokens").cast("bigint").alias("total_tokens"),
        F.sum("redactions").cast("bigint").alias("redactions"),
        F.count_if("is_omitted").alias("omitted_files"),
    ).join(stack.gather(stats.filter("techs IS NOT NULL")), "pack_id", "left")
    log = None
    if spec.log_commits is not None and commits is not None:
        log = history.commit_log(commits, spec.log_commits)
    return Pack(spec, files, selection, stats, materialize(totals), log, diffs, packs)


# names a persona goes by, in lower case, and its full name
PERSONA_NAMES = {name: name for name in fixed.PERSONA_HEADERS} | {slug: name for name, slug in fixed.PERSONA_SLUGS.items()}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.lower(key))


def require_choices(packs: DataFrame | None) -> None:
    """A pack that names an unknown persona or recipe is an error, as in a spec."""
    for column, known in (("persona", PERSONA_NAMES), ("recipe", fixed.RECIPES)):
        if packs is not None and column in packs.columns:
            bad = packs.filter(F.col(column).isNotNull() & ~F.lower(column).isin(*known)).select(column).first()
            if bad is not None:
                raise ValueError(f"unknown {column} {bad[0]!r}; known: {', '.join(known)}")


def with_choices(totals: DataFrame, spec: PackSpec, packs: DataFrame | None = None) -> DataFrame:
    """Add ``persona`` (full name) and ``task_body`` per pack, null for none: from ``packs``, else from the spec."""
    own = [c for c in ("persona", "recipe", "task") if packs is not None and c in packs.columns]
    out = totals.join(packs.select("pack_id", *[F.col(c).alias(f"_{c}") for c in own]), "pack_id", "left") if own else totals

    def choice(name: str) -> Column:
        of_spec = F.lit(getattr(spec, name)).cast("string")
        return F.coalesce(F.col(f"_{name}"), of_spec) if name in own else of_spec

    prompts = {name: prompt for name, (_, prompt) in fixed.RECIPES.items()}
    task = choice("task")
    body = F.concat_ws("\n\n", F.when(~text.is_blank(task), task), _looked_up(prompts, choice("recipe")))
    return out.withColumns({"persona": _looked_up(PERSONA_NAMES, choice("persona")), "task_body": F.nullif(body, F.lit(""))}).drop(
        *[f"_{c}" for c in own]
    )


def header(totals: DataFrame, spec: PackSpec, packs: DataFrame | None = None) -> DataFrame:
    """Header text per pack (K7): persona, root, counts, stack, task, safety; with ``persona`` and ``task_body``."""
    lines = [
        _looked_up(fixed.PERSONA_HEADERS, F.col("persona")),
        F.concat(F.lit("Root: "), F.col("pack_id")),
        F.concat(F.lit("Total Files: "), F.col("total_files").cast("string")),
        F.concat(F.lit("Total Tokens: "), F.col("total_tokens").cast("string")),
        F.when(
            F.size("tech_stack") > 0, F.concat(F.lit("Tech Stack: "), F.array_join("tech_stack", ", "))
        ),
        F.when(F.col("task_body").isNotNull(), "Task Status: Pending (See end of file)"),
        text.safety_line(F.col("redactions"), spec.redact),
    ]
    return with_choices(totals, spec, packs).withColumn("header", F.concat_ws("\n", *lines))


def dry_run(plan: Pack) -> DataFrame:
    """Every file by tokens, heaviest first."""
    return plan.stats.select("pack_id", "path", "tokens").orderBy(
        "pack_id", F.col("tokens").desc(), "path"
    )


def summary(plan: Pack) -> DataFrame:
    """Totals with severity and warning flag."""
    return plan.totals.withColumn("severity", text.token_severity(F.col("total_tokens"))).withColumn(
        "over_warning", F.col("total_tokens") > fixed.TOKEN_BUDGET_WARNING
    )


def hogs(plan: Pack, depth: int | str = 0) -> DataFrame:
    """Hog report: 0 = files, n = directories at depth n, "auto" = both."""
    if depth == "auto":
        entries = rollup.auto_hogs(plan.stats)
    elif depth == 0:
        entries = rollup.file_hogs(plan.stats)
    else:
        entries = rollup.directory_hogs(rollup.directory_tokens(plan.stats), int(depth))
    return rollup.with_share(entries, plan.totals)
