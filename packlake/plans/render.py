"""Rendered packs as ordered text sections.

A document is a set of rows ``(pack_id, section, rank, key, entry, text)``.
Sorted by those columns and joined with line feeds the texts form the document;
``(pack_id, section, entry)`` names a row.  A document is never put together in
one value unless a size bound allows it: see :func:`volumes`.

Where a section stands is known before any file is rendered.  A renderer makes
the same rows from the narrow facts of files, with empty bodies; lines and bytes
of a section are those of this frame plus the body's own, which the scan has
counted (:func:`measures`).  Offsets are running sums of that table.  They reach
the files as columns of their facts, so that text meets facts and offsets in one
join and is rendered once (:func:`located`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import text
from packlake.operators import tree
from packlake.operators.order import path_key
from packlake.operators.spread import join_per_pack, running
from packlake.plans.pack import Pack, header
from packlake.session import materialize

SEPARATOR = "=" * 48
PART_BYTES = 128 * 1024 * 1024
SECTION_KEY = ["pack_id", "section", "entry"]
OFFSETS = ["line_offset", "byte_offset"]
SECTION_ORDER = ["section", "rank", "key", "entry"]

# section numbers, in document order
TOP, TREE, AFTER_TREE, TOC, META, FILES, LOG, DIFF, TASK, END = range(10)


def _rank(files: DataFrame, sort: str) -> Column:
    """Leading numeric key of the output order, before the path."""
    if sort == "churn":
        return F.col("churn").cast("bigint")
    return (F.col("size_bytes") if sort == "size" else F.lit(0)).cast("bigint")


def _log_bodies(log: DataFrame) -> DataFrame:
    """Commit lines of each pack as one text; the requested number bounds it."""
    newest_first = F.sort_array(F.collect_list(F.struct("commit_no", "line")))
    return log.groupBy("pack_id").agg(
        F.array_join(F.transform(newest_first, lambda c: c["line"]), "\n").alias("body")
    )


def diff_pieces(diffs: DataFrame) -> DataFrame:
    """(pack_id, path, entry, diff): the pieces of diff text that are not blank; those of a pack stand by path and part.

    A table without ``path`` or ``part`` has one piece per pack, or per path.
    """
    path = F.coalesce("path", F.lit("")) if "path" in diffs.columns else F.lit("")
    part = F.coalesce(F.col("part").cast("bigint"), F.lit(0).cast("bigint")) if "part" in diffs.columns else F.lit(0).cast("bigint")
    entry = F.concat(path, F.lit("#"), F.lpad(part.cast("string"), 19, "0"))
    return diffs.filter(~text.is_blank(F.col("diff"))).select("pack_id", path.alias("path"), entry.alias("entry"), "diff")


class _Builder:
    """Collects section rows with one uniform schema.

    ``files`` has the facts of the packed files and ``shown``, their finished body
    or null; ``carry`` names columns of it that file sections keep.
    """

    def __init__(self, plan: Pack, files: DataFrame | None = None, carry: list[str] | None = None):
        self.plan = plan
        self.files = files
        self.carry = carry or []
        self.spec = plan.spec
        self.collation = plan.spec.collation
        self.packs = header(plan.totals, plan.spec, plan.packs).select(
            "pack_id", "header", "total_files", "total_tokens", "redactions", "tech_stack", "persona", "task_body"
        )
        self.rows: list[DataFrame] = []
        self.file_rows: list[DataFrame] = []

    def add(
        self,
        source: DataFrame,
        section: int,
        body: Column,
        entry: Column | None = None,
        key: Column | None = None,
        rank: Column | None = None,
    ) -> None:
        first = F.array(path_key("_none", self.collation))
        kept = self.carry if section == FILES else []
        (self.file_rows if section == FILES else self.rows).append(
            source.withColumn("_none", F.lit("")).select(
                "pack_id",
                F.lit(section).alias("section"),
                (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"),
                (first if key is None else key).alias("key"),
                (F.lit("") if entry is None else entry).alias("entry"),
                body.alias("text"),
                *kept,
            )
        )

    def per_pack(self, section: int, body: Column | str) -> None:
        self.add(self.packs, section, F.lit(body) if isinstance(body, str) else body)

    def tree(self, line: Column | None = None) -> None:
        lines = tree.tree_lines(self.plan.stats, self.spec.max_file_kb, self.collation)
        self.add(lines, TREE, F.col("line") if line is None else line, F.col("node"), F.col("tree_key"))

    def per_file(self, section: int, files: DataFrame, body: Column) -> None:
        key = F.array(path_key("path", self.collation))
        self.add(files, section, body, F.col("path"), key, _rank(files, self.spec.sort))

    def log(self, body_of) -> None:
        """Commit lines of a pack; bounded by the requested number of commits."""
        if self.plan.log is None:
            return
        self.add(_log_bodies(self.plan.log), LOG, body_of(F.col("body")))

    def diff(self, before: Column | str | None = None, after: Column | str | None = None, piece=lambda body: body) -> None:
        """Diff text, a row per piece, between a row before and one after it; a pack without any renders nothing.

        ``before`` and ``after`` may use ``fence``, one that no piece of the pack breaks.
        """
        if self.plan.diffs is None:
            return
        pieces = diff_pieces(self.plan.diffs)
        fences = pieces.groupBy("pack_id").agg(F.max(F.length(text.fence_for(F.col("diff")))).alias("_n"))
        packs = fences.select("pack_id", F.repeat(F.lit("`"), F.col("_n")).alias("fence"))
        key = F.array(path_key("path", self.collation))
        rows = [(packs, before, F.lit("start"), None, 0), (pieces, piece(F.col("diff")), F.col("entry"), key, 1), (packs, after, F.lit("stop"), None, 2)]
        for source, body, entry, at, rank in rows:
            if body is not None:
                self.add(source, DIFF, F.lit(body) if isinstance(body, str) else body, entry, at, F.lit(rank))

    def task(self, body_of) -> None:
        self.add(self.packs.filter("task_body IS NOT NULL"), TASK, body_of(F.col("task_body")))

    def union(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.rows + self.file_rows)


def _bodies(files: DataFrame, spec) -> DataFrame:
    """``shown``: the finished body of files with text."""
    content = F.col("content")
    body = text.add_line_numbers(content) if spec.line_numbers else content
    return files.withColumn("shown", F.when(F.col("has_content"), body)).drop("content")


def _note(spec) -> Column:
    return text.unavailable_note(
        F.col("is_binary"), F.col("is_oversized"), F.col("is_omitted"), spec.max_file_kb
    )


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def markdown(b: _Builder) -> None:
    """Markdown sections (K1)."""
    plan = b.plan
    slug = text.heading_slug(F.col("path"))
    b.per_pack(TOP, "```")
    b.tree()
    b.per_pack(AFTER_TREE, "```\n\n## Table of Contents\n")
    toc = F.concat(F.lit("- ["), F.col("path"), F.lit("](#"), slug, F.lit(")"))
    b.per_file(TOC, plan.stats.filter("has_content"), toc)
    b.per_pack(META, _lines("", "```", F.col("header"), "```", ""))
    title = F.concat(F.lit("## "), F.col("path"), F.lit(" {#"), slug, F.lit("}"))
    fence = F.col("fence")
    block = _lines(
        title,
        "",
        F.concat(fence, F.coalesce(text.fence_language(F.col("path")), F.lit(""))),
        F.col("shown"),
        fence,
        "",
    )
    b.per_file(
        FILES, b.files, F.when(F.col("has_content"), block).otherwise(_lines(title, "", _note(plan.spec), ""))
    )
    b.log(lambda body: _lines("## Recent Commits", "", "```", body, "```", ""))
    b.diff(
        _lines("## Git Diff (uncommitted changes)", "", F.concat(F.col("fence"), F.lit("diff"))),
        _lines(F.col("fence"), ""),
    )
    b.task(
        lambda body: _lines(
            "## User Task / Instructions", "", text.fence_for(body), body, text.fence_for(body), ""
        )
    )


def xml(b: _Builder) -> None:
    """XML sections (K2): frame parts in CDATA, file text entity-escaped."""
    plan = b.plan

    def cdata(tag: str):
        return lambda body: _lines(f"<{tag}><![CDATA[", body, f"]]></{tag}>")

    b.per_pack(TOP, f"<{fixed.BRAND}>\n<tree><![CDATA[")
    b.tree()
    task = F.when(F.col("task_body").isNotNull(), cdata("task")(F.col("task_body")))
    b.per_pack(AFTER_TREE, _lines("]]></tree>", cdata("metadata")(F.col("header")), task))
    shown = F.coalesce("shown", _note(plan.spec))
    b.per_file(
        FILES,
        b.files,
        F.concat(
            F.lit('<file path="'),
            text.xml_escape(F.col("path")),
            F.lit('">'),
            text.xml_escape(shown),
            F.lit("</file>"),
        ),
    )
    b.log(cdata("gitLog"))
    b.diff("<gitDiff><![CDATA[", "]]></gitDiff>")
    b.per_pack(END, f"</{fixed.BRAND}>")


def plain(b: _Builder) -> None:
    """Separator-delimited sections (K3)."""

    def block(title: Column | str, *body: Column | str) -> Column:
        return _lines(SEPARATOR, title, SEPARATOR, *body)

    b.per_pack(
        TOP,
        _lines(
            block(f"{fixed.BRAND.upper()} CONTEXT", F.col("header"), ""),
            block("DIRECTORY STRUCTURE"),
        ),
    )
    b.tree()
    b.per_pack(AFTER_TREE, "")
    shown = F.coalesce("shown", _note(b.spec))
    b.per_file(FILES, b.files, block(F.concat(F.lit("File: "), F.col("path")), shown, ""))
    b.log(lambda body: block("RECENT COMMITS", body, ""))
    b.diff(block("GIT DIFF (uncommitted changes)"), "")
    b.task(lambda body: block("USER TASK / INSTRUCTIONS", body, ""))


def json_records(b: _Builder) -> None:
    """One JSON record per metadata, tree line, file, log, diff and task (K4).

    :func:`json_documents` has the nested form.
    """
    b.per_pack(
        TOP,
        F.to_json(
            F.struct(
                F.lit("metadata").alias("type"),
                F.col("pack_id").alias("root"),
                F.col("total_files").alias("totalFiles"),
                F.col("total_tokens").alias("totalTokens"),
                F.coalesce("tech_stack", F.array().cast("array<string>")).alias("techStack"),
                "persona",
                F.col("redactions").alias("redactedSecrets"),
                F.lit(fixed.BRAND).alias("generator"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )
    b.tree(F.to_json(F.struct(F.lit("tree").alias("type"), F.col("line"))))
    b.per_file(
        FILES,
        b.files,
        F.to_json(
            F.struct(
                F.lit("file").alias("type"),
                "path",
                "tokens",
                F.col("is_binary").alias("binary"),
                F.col("is_oversized").alias("oversized"),
                F.col("is_omitted").alias("omitted"),
                F.col("shown").alias("content"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )

    def record(kind: str):
        return lambda body: F.to_json(F.struct(F.lit(kind).alias("type"), body.alias("text")))

    b.log(record("gitLog"))
    b.diff(piece=record("gitDiff"))
    b.task(record("task"))


RENDERERS = {"markdown": markdown, "xml": xml, "plain": plain, "json": json_records}


def _rendered(plan: Pack, render, stats: DataFrame | None = None, carry: list[str] | None = None) -> _Builder:
    """A builder filled with the document's texts; ``carry`` columns of ``stats`` stay on file sections."""
    b = _Builder(plan, _bodies(plan.with_text(plan.stats if stats is None else stats), plan.spec), carry)
    render(b)
    return b


def sections(plan: Pack) -> DataFrame:
    """Section rows in the format of the plan's spec."""
    return _rendered(plan, RENDERERS[plan.spec.format]).union()


def measures(plan: Pack, render=None) -> DataFrame:
    """(pack_id, section, rank, key, entry, n_lines, n_bytes) of every section, from facts alone."""
    has = F.col("has_content")
    own = [F.when(has, F.col(c)).alias(c) for c in ("body_lines", "body_bytes")]
    framed = plan.stats.select(*[c for c in plan.stats.columns if c not in ("body_lines", "body_bytes")], *own)
    b = _Builder(plan, framed.withColumn("shown", F.when(has, F.lit(""))), ["body_lines", "body_bytes"])
    (render or RENDERERS[plan.spec.format])(b)
    none = F.lit(0).cast("bigint")
    small = reduce(DataFrame.unionByName, b.rows).withColumns({"body_lines": none + 1, "body_bytes": none})
    frames = reduce(DataFrame.unionByName, b.file_rows, small)
    return frames.select(
        "pack_id",
        *SECTION_ORDER,
        (text.line_count(F.col("text")) + F.coalesce("body_lines", none + 1) - 1).alias("n_lines"),
        (F.octet_length("text") + F.coalesce("body_bytes", none)).alias("n_bytes"),
    )


def _offsets(narrow: DataFrame, separator: str) -> DataFrame:
    """Written ``narrow`` with the lines and bytes before each section of its pack."""
    sized = narrow.withColumn("n_bytes", F.col("n_bytes") + len(separator))
    order = [F.col(c).asc() for c in SECTION_ORDER]
    return materialize(running(sized, ["pack_id"], order, {"line_offset": "n_lines", "byte_offset": "n_bytes"}))


def located(plan: Pack, render=None, separator: str = "\n", places: DataFrame | None = None) -> DataFrame:
    """Section rows with ``line_offset`` and ``byte_offset``: what stands before them in their pack.

    ``places`` are offsets made before, with further columns to carry along.
    """
    render = render or RENDERERS[plan.spec.format]
    placed = _offsets(measures(plan, render), separator) if places is None else places
    known = {*SECTION_KEY, *SECTION_ORDER, "n_lines", "n_bytes"}
    carry = [c for c in placed.columns if c not in known]
    of_files = placed.filter(F.col("section") == FILES).select("pack_id", F.col("entry").alias("path"), *carry)
    b = _rendered(plan, render, plan.stats.join(of_files, ["pack_id", "path"]), carry)
    others = placed.filter(F.col("section") != FILES).select(*SECTION_KEY, *carry)
    frame = reduce(DataFrame.unionByName, b.rows).join(others, SECTION_KEY)
    return reduce(DataFrame.unionByName, b.file_rows, frame)


def ordered(plan: Pack) -> DataFrame:
    """Section rows of all packs in document order, within and across partitions (K8).

    Partitions are cut by the offsets, so nothing is rendered to find their
    bounds; there are at least as many as the session has shuffle partitions.
    """
    placed = _offsets(measures(plan), "\n")
    sizes = placed.groupBy("pack_id").agg(F.sum("n_bytes").alias("size"))
    starts = materialize(running(sizes, [], [F.col("pack_id")], {"start": "size"}))
    total = starts.agg(F.sum("size")).first()[0] or 0
    parts = max(int(plan.totals.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    at = F.col("start") + F.col("byte_offset")
    part = F.least(F.floor(at * parts / max(1, total)), F.lit(parts - 1)).cast("int")
    cut = join_per_pack(placed, starts.drop("size"), ["pack_id"], spread_by="entry").withColumn("part", part).drop("start")
    rows = located(plan, places=materialize(cut))
    return rows.repartitionById(parts, "part").sortWithinPartitions("pack_id", "byte_offset").drop("part")


def tree_only(plan: Pack) -> DataFrame:
    """Only the directory tree (K6)."""
    return tree.tree_lines(plan.stats, plan.spec.max_file_kb, plan.spec.collation)


def tree_sections(plan: Pack) -> DataFrame:
    """The tree as section rows (K6)."""
    b = _Builder(plan)
    b.tree()
    return b.union()


def with_lines(plan: Pack) -> DataFrame:
    """Section rows with ``first_line``: where each starts inside its pack."""
    return located(plan).withColumn("first_line", F.col("line_offset") + 1).drop(*OFFSETS)


def _volumes(rows: DataFrame, max_bytes: int, separator: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("byte_offset", "text")))
    return rows.groupBy("pack_id", F.floor(F.col("byte_offset") / max_bytes).alias("volume")).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), separator).alias("document"),
        F.min("section").alias("first_section"),
    )


def volumes(plan: Pack, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Documents as values, cut into volumes of about ``max_bytes`` (A10, K8).

    Sections are packed by their running byte offset, so a volume never exceeds
    the limit by more than one section; a pack below the limit is one volume.
    Joining a pack's volumes with line feeds gives the whole document.
    """
    return _volumes(located(plan), max_bytes, "\n").drop("first_section")


def tree_volumes(plan: Pack, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Only the tree, in volumes (K6); its lines are short, so they are measured as they are."""
    rows = tree_sections(plan)
    narrow = rows.select("pack_id", *SECTION_ORDER, F.lit(1).alias("n_lines"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    return _volumes(rows.join(_offsets(narrow, "\n").select(*SECTION_KEY, *OFFSETS), SECTION_KEY), max_bytes, "\n").drop("first_section")


def json_sections(b: _Builder) -> None:
    """The nested JSON document of every pack as section rows (K4); their texts follow each other without separators.

    A list's first element has no comma before it, so the first tree line and
    the first file of each pack are looked up in narrow tables.
    """
    plan, spec = b.plan, b.spec
    string = text.json_string

    def field(name: str, value: Column, depth: int) -> Column:
        return F.concat(F.lit(" " * depth + f'"{name}": '), F.coalesce(value, F.lit("null")))

    def fields(depth: int, **values: Column) -> Column:
        return F.concat_ws(",\n", *[field(name, value, depth) for name, value in values.items()])

    stack = F.transform(F.coalesce("tech_stack", F.array().cast("array<string>")), lambda t: F.concat(F.lit("      "), string(t)))
    listed = F.when(F.size(stack) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(stack, ",\n"), F.lit("\n    ]")))
    metadata = fields(
        4,
        root=string(F.col("pack_id")),
        totalFiles=F.col("total_files").cast("string"),
        totalTokens=F.col("total_tokens").cast("string"),
        techStack=listed,
        persona=string(F.col("persona")),
        redactedSecrets=F.col("redactions").cast("string"),
        generator=string(F.lit(fixed.BRAND)),
    )
    b.per_pack(TOP, F.concat(F.lit('{\n  "metadata": {\n'), metadata, F.lit('\n  },\n  "tree": "')))

    lines = tree_only(plan)
    first_line = lines.groupBy("pack_id").agg(F.min("tree_key").alias("_first"))
    marked = join_per_pack(lines, first_line, ["pack_id"], spread_by="node")
    escaped = F.expr("substr(_json, 2, length(_json) - 2)")
    line = F.concat(F.when(F.col("tree_key") == F.col("_first"), F.lit("")).otherwise(F.lit("\\n")), escaped)
    b.add(marked.withColumn("_json", string(F.col("line"))), TREE, line, F.col("node"), F.col("tree_key"))

    b.per_pack(META, '",\n  "files": [\n')
    first = F.min_by("path", F.struct(_rank(plan.stats, spec.sort), path_key("path", spec.collation)))
    files = join_per_pack(b.files, plan.stats.groupBy("pack_id").agg(first.alias("_first")), ["pack_id"])
    entry = fields(
        6,
        path=string(F.col("path")),
        tokens=F.col("tokens").cast("string"),
        binary=F.col("is_binary").cast("string"),
        oversized=F.col("is_oversized").cast("string"),
        omitted=F.col("is_omitted").cast("string"),
        content=string(F.col("shown")),
    )
    comma = F.when(F.col("path") == F.col("_first"), F.lit("")).otherwise(F.lit(",\n"))
    b.per_file(FILES, files, F.concat(comma, F.lit("    {\n"), entry, F.lit("\n    }")))

    none = plan.totals.select("pack_id").limit(0)
    log = none.withColumn("body", F.lit("")) if plan.log is None else _log_bodies(plan.log)
    ends = b.packs.join(log, "pack_id", "left")
    closing = fields(2, task=string(F.col("task_body")), gitLog=string(F.col("body")))
    pieces = None if plan.diffs is None else diff_pieces(plan.diffs)
    if pieces is None:
        b.add(ends, END, F.concat(F.lit("\n  ],\n"), closing, F.lit(',\n  "gitDiff": null\n}')))
        return
    place = F.struct(path_key("path", spec.collation), "entry")
    first = pieces.groupBy("pack_id").agg(F.min_by("entry", place).alias("_first"))
    ends = ends.join(first, "pack_id", "left")
    some = F.col("_first").isNotNull()
    b.add(ends, LOG, F.concat(F.lit("\n  ],\n"), closing, F.lit(',\n  "gitDiff": '), F.when(some, F.lit('"')).otherwise(F.lit("null"))))
    # line feeds between pieces are part of the one string they make
    marked = join_per_pack(pieces, first, ["pack_id"], spread_by="entry").withColumn("_json", string(F.col("diff")))
    piece = F.concat(F.when(F.col("entry") == F.col("_first"), F.lit("")).otherwise(F.lit("\\n")), escaped)
    b.add(marked, DIFF, piece, F.col("entry"), F.array(path_key("path", spec.collation)))
    b.add(ends, END, F.concat(F.when(some, F.lit('"')).otherwise(F.lit("")), F.lit("\n}")))


def json_documents(plan: Pack, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """The nested JSON document of every pack, whole, in volumes of about ``max_bytes`` (K4).

    A pack's volumes follow each other without a separator; a pack below the
    size is one volume.  ``first_section`` is the section a volume begins in.
    """
    return _volumes(located(plan, json_sections, ""), max_bytes, "")


def json_rows(documents: DataFrame) -> DataFrame:
    """(pack_id, kind, value): what nested JSON documents hold, read volume by volume (K4).

    Kinds are ``metadata``, ``tree`` and ``diff`` (a line each), ``file`` and
    ``closing`` (task and log); but for lines a value is a JSON object.  A volume
    is made of whole sections and a line feed inside a JSON string is escaped, so
    line feeds and the first section tell the layout and no volume needs another
    one: a pack is never put together.
    """
    doc, first = F.col("document"), F.col("first_section")
    none = F.array().cast("array<string>")

    def unescaped(pattern: str, *goes_on: int) -> Column:
        """Lines of a JSON string that begins by ``pattern``, or goes on from the volume before in these sections."""
        opened = F.regexp_extract_all(doc, F.lit(pattern + r'([^"\n\\]*+(?:\\.[^"\n\\]*+)*+)(?:"|\z)'), F.lit(1))
        rest = F.regexp_extract(doc, r'\A([^"\n\\]*+(?:\\.[^"\n\\]*+)*+)(?:"|\z)', 1)
        pieces = F.concat(F.when(first.isin(*goes_on), F.array(rest)).otherwise(none), opened)
        texts = F.transform(pieces, lambda p: F.from_json(F.concat(F.lit('["'), p, F.lit('"]')), "array<string>")[0])
        return F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, "\n", -1))), lambda line: line != "")

    top = F.regexp_extract(doc, r'(?s)\A\{\n  "metadata": (\{.*?\n  \}),\n  "tree": "', 1)
    branches = unescaped(r'(?m)\n  "tree": "', TREE, META)
    changes = unescaped(r'(?m)\n  "gitDiff": "', DIFF)
    entries = F.regexp_extract_all(doc, F.lit(r"(?m)^    \{\n(?:      [^\n]*+\n){6}    \}"), F.lit(0))
    end = F.regexp_extract(doc, r'(?s)\n  \],\n(  "task".*?),\n  "gitDiff": ', 1)

    def one(value: Column) -> Column:
        return F.filter(F.array(value), lambda v: v != "")

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    closing = F.transform(one(end), lambda v: F.concat(F.lit("{"), v, F.lit("}")))
    found = F.concat(of("metadata", one(top)), of("tree", branches), of("file", entries), of("diff", changes), of("closing", closing))
    return documents.select("pack_id", F.inline(found))


def write_text(plan: Pack, path: str) -> None:
    """Write the documents as text files per pack, in document order (K8).

    Large packs are split over many part files, whose names sort in document order.
    """
    ordered(plan).select("pack_id", F.col("text").alias("value")).write.partitionBy("pack_id").text(path)
