"""A file tree as a data source, `spark.read.format("tree").load(root)` after `register(spark)`.

Rows: path (below the root), ending (behind the last dot of the name, lower case, "" without one), size, mtime, content (text;
bytes that are no UTF-8 are replaced). Only the upper folders are listed while the scan is planned, breadth first until there
are `readers` of them; each is a task that lists what lies below it and opens the files. Filters on ending and on path
(starts or ends with) reach the reader: folders outside a prefix aren't listed, other files aren't opened.

Options: `readers` (64), `exclude` (names of folders, by comma, that aren't entered), `contents` ("false" leaves files closed,
content is null), `lag` (milliseconds, 1000; streams). Any store that Arrow knows, or a path that driver and executors share.

As a stream, an offset is a time: a batch has the files whose mtime lies behind the last offset and up to `lag` before now.
Nothing is kept about files, so a batch can be made again after a failure, however long the tree has been watched; a file that
changed twice since comes with its last state, in the later batch. Deletions leave no time behind: they show in a comparison of
two scans (`incremental.changes`).

Defined results: empty files have content ""; an empty root has no rows, a missing one is an error; a file that goes while the
scan runs is passed over.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, ending string, size long, mtime timestamp, content string"
ARROW = pa.schema([("path", pa.string()), ("ending", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.string())])
READERS, LAG, NAMES = 64, 1000, 1000


class Folder(InputPartition):
    """A folder of which one task reads the files, those below it included if `deep`; files changed in (since, until] only."""

    def __init__(self, path: str, deep: bool, since: int | None = None, until: int | None = None) -> None:
        super().__init__(0)
        self.path, self.deep, self.since, self.until = path, deep, since, until


class Wanted(NamedTuple):
    """What the pushed filters leave: endings (None: all), beginnings and ends that a path must have."""

    endings: frozenset[str] | None = None
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()

    def folder(self, path: str) -> bool:
        """Whether files below a folder may have the beginnings."""
        inside = path + "/" if path else ""
        return all(s.startswith(inside) or inside.startswith(s) for s in self.starts)

    def file(self, path: str, ending: str) -> bool:
        return (self.endings is None or ending in self.endings) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))


def ending_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


class Tree:
    """The walks of a root; made anew in each task."""

    def __init__(self, options: dict[str, str]) -> None:
        root = options["path"]
        if re.match(r"^\w+:/", root):
            self.fs, base = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
        else:
            self.fs, base = pafs.LocalFileSystem(), root
        self.base = base.rstrip("/")
        self.exclude = {x.strip() for x in options.get("exclude", "").split(",")} - {""}
        self.contents = options.get("contents", "true").lower() != "false"

    def entries(self, path: str) -> tuple[list[str], list[pafs.FileInfo]]:
        """The folders and files right below a folder, by name."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.base}/{path}".rstrip("/")))
        found.sort(key=lambda f: f.base_name)
        down = [f"{path}/{f.base_name}".lstrip("/") for f in found if f.type == pafs.FileType.Directory and f.base_name not in self.exclude]
        return down, [f for f in found if f.type == pafs.FileType.File]

    def folders(self, readers: int, wanted: Wanted, since: int | None = None, until: int | None = None) -> list[Folder]:
        flat, level = [], [""]
        while level and len(level) + len(flat) < readers:
            down = []
            for p in level:
                below, files = self.entries(p)
                down += [d for d in below if wanted.folder(d)]
                if files:
                    flat.append(p)
            level = down
        return [Folder(p, False, since, until) for p in flat] + [Folder(p, True, since, until) for p in level]

    def read(self, folder: Folder | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        #: Spark reads a source without parts as one part that is None
        stack, rows = [folder.path] if folder else [], []
        while stack:
            path = stack.pop()
            try:
                down, files = self.entries(path)
            except FileNotFoundError:
                continue
            if folder.deep:
                stack += [d for d in reversed(down) if wanted.folder(d)]
            for f in files:
                name = f"{path}/{f.base_name}".lstrip("/")
                ending = ending_of(name)
                if not wanted.file(name, ending) or folder.until is not None and not folder.since < f.mtime_ns <= folder.until:
                    continue
                text = None
                if self.contents:
                    try:
                        with self.fs.open_input_stream(f.path) as opened:
                            text = opened.read().decode(errors="replace")
                    except FileNotFoundError:
                        continue
                rows.append((name, ending, f.size, f.mtime_ns // 1000, text))
                if self.contents or len(rows) == NAMES:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.wanted = options, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            w = self.wanted
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ending",):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = w._replace(endings=values if w.endings is None else w.endings & values)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.wanted = w._replace(starts=(*w.starts, f.value))
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.wanted = w._replace(ends=(*w.ends, f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return Tree(self.options).folders(int(self.options.get("readers", READERS)), self.wanted)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return Tree(self.options).read(partition, self.wanted)


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.options.get("lag", LAG)) * 1_000_000}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return Tree(self.options).folders(int(self.options.get("readers", READERS)), Wanted(), start["until"], end["until"])

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return Tree(self.options).read(partition, Wanted())


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)
