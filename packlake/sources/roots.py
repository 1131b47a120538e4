"""A Spark data source over directories (S1, S5-S8): ``spark.read.format("packfiles")``.

Options: ``roots``, a JSON list of [pack_id, folder] pairs; ``max_bytes``, the size up
to which files are read; ``prune``, a JSON list of globs ending in ``/**`` below
which nothing is listed.  Folders are paths or URIs of any file system pyarrow
opens, and every executor must see them.

Planning lists directories breadth first, only until there are ``UNITS`` pieces of
work, a piece being the files of one directory or a whole subtree.  The number of
pieces does not grow with the data, and no file is listed on the driver.  Tasks
walk their subtrees and hand rows on in batches of about ``BATCH_BYTES``.

Names may begin with a dot or an underscore.  Links are not followed, so each
file is listed once.  Larger files are opened for their first ``SNIFFED`` bytes
only, which tell whether they are text.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packlake import fixed
from packlake.operators.ignore import glob_regex
from packlake.operators.scan import SNIFFED
from packlake.spec import PackSpec

UNITS, PARTITIONS = 4096, 256
BATCH_BYTES, BATCH_FILES = 8 * 2**20, 1000
SCHEMA = pa.schema([("pack_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("head", pa.binary()), ("raw", pa.binary())])


class Folder:
    """Lists and opens what lies below one root."""

    def __init__(self, root: str):
        if "://" in root:
            self.fs, self.base = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.base = fs.LocalFileSystem(), os.path.abspath(root)
        self.base = self.base.rstrip("/")
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def entries(self, below: str) -> list[tuple[str, bool, int]]:
        """(relative path, is a directory, size) of one directory, links left out, in order."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{below}".rstrip("/")))
        out = []
        for info in found:
            if info.type in (fs.FileType.File, fs.FileType.Directory) and not (self.local and os.path.islink(info.path)):
                path = f"{below}/{info.base_name}" if below else info.base_name
                out.append((path, info.type == fs.FileType.Directory, info.size or 0))
        return sorted(out)

    def read(self, path: str, n: int | None = None) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{path}") as handle:
            return handle.read(n)


class Pieces(InputPartition):
    """(pack_id, root, directory, whole subtree?) of one task."""

    def __init__(self, pieces: list[tuple[str, str, str, bool]]):
        self.pieces = pieces


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [tuple(pair) for pair in json.loads(options["roots"])]
        self.max_bytes = int(options["max_bytes"])
        globs = json.loads(options.get("prune", "[]"))
        if any(not g.endswith("/**") for g in globs):
            raise ValueError("prune takes globs that end in /**")
        self.prune = [glob_regex(g).replace(r"\z", r"\Z") for g in globs]

    def _pruned(self, directory: str) -> bool:
        return any(re.match(regex, f"{directory}/\x01") for regex in self.prune)

    def partitions(self) -> list[InputPartition]:
        done: list[tuple[str, str, str, bool]] = []
        todo = deque((pack, root, "") for pack, root in self.roots)
        while todo and len(todo) + len(done) < UNITS:
            pack, root, directory = todo.popleft()
            below = [p for p, is_dir, _ in Folder(root).entries(directory) if is_dir and not self._pruned(p)]
            done.append((pack, root, directory, False))
            todo += [(pack, root, p) for p in below]
        done += [(*piece, True) for piece in todo]
        n = min(PARTITIONS, max(1, len(done)))
        return [Pieces(done[k::n]) for k in range(n)]

    def _files(self, pieces: list[tuple[str, str, str, bool]]) -> Iterator[tuple[Folder, str, str, int]]:
        for pack, root, start, whole in pieces:
            folder, todo = Folder(root), [start]
            while todo:
                for path, is_dir, size in folder.entries(todo.pop()):
                    if not is_dir:
                        yield folder, pack, path, size
                    elif whole and not self._pruned(path):
                        todo.append(path)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

        for folder, pack, path, size in self._files(partition.pieces):
            raw = folder.read(path) if size <= self.max_bytes else None
            head = raw[:SNIFFED] if raw is not None else folder.read(path, SNIFFED)
            rows.append((pack, path, size, head, raw))
            held += len(raw or head)
            if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()


class PackFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packfiles"

    def schema(self) -> str:
        return "pack_id string, path string, size_bytes bigint, head binary, raw binary"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def from_roots(spark: SparkSession, roots: dict[str, str], spec: PackSpec | None = None) -> DataFrame:
    """The ``files`` table of any number of directories, pack_id -> folder.

    The spec's size limit is the only one.  Directories that the built-in excludes
    cover are not listed, unless the spec force-includes paths.
    """
    spec = spec or PackSpec()
    spark.dataSource.register(PackFiles)
    prune = [] if spec.includes else [g for g in fixed.DEFAULT_EXCLUDES if g.endswith("/**")]
    options = {"roots": json.dumps(sorted(roots.items())), "max_bytes": str(spec.max_file_bytes), "prune": json.dumps(prune)}
    return spark.read.format("packfiles").options(**options).load()
