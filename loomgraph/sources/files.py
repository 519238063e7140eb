"""A workspace as a data source: partitions list their own folders, and open the files that they find there.

Excluded folders are never entered, and no path of a file comes to the driver. Hidden names (`.eslintrc.js`,
`__init__.py`), which Spark's own file listing leaves out, are files like any other.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from loomgraph.functions import text as X
from loomgraph.session import ship

#: Bytes of contents in a batch, but for a longer file.
BATCH_BYTES = 4 << 20
#: Files of a partition, where the planner knows how many a folder has; larger folders are dealt out by a hash of the path.
PART_FILES = 256
#: Folders that the planner didn't list are dealt out to so many partitions, as one may hold most files; each lists their names.
SLICES = 4
_ENDINGS = tuple(f".{e}" for e in X.INCLUDED)
_SCHEMA = pa.schema([("path", pa.string()), ("root", pa.string()), ("content", pa.binary())])


@dataclass
class Part(InputPartition):
    """Folders (with what lies below them, if deep), and which of their files are this partition's."""

    folders: tuple[str, ...]
    deep: bool
    part: int = 0
    parts: int = 1


class Wanted:
    """What pushed filters say of paths: every list of one of the kinds must have a value that fits."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, tuple[str, ...]]] = []

    def take(self, pushed: Filter) -> bool:
        """Whether this filter is seen to here."""
        if getattr(pushed, "attribute", None) != ("path",):
            return False
        if isinstance(pushed, In):
            self.tests.append(("is", tuple(v for v in pushed.value if v is not None)))
        elif isinstance(pushed, (EqualTo, StringStartsWith, StringEndsWith)) and pushed.value is not None:
            kind = "is" if isinstance(pushed, EqualTo) else "starts" if isinstance(pushed, StringStartsWith) else "ends"
            self.tests.append((kind, (pushed.value,)))
        else:
            return False
        return True

    def file(self, path: str) -> bool:
        return all(path in values if kind == "is" else path.startswith(values) if kind == "starts" else path.endswith(values) for kind, values in self.tests)

    def folder(self, path: str) -> bool:
        """Whether a wanted file may lie below this folder."""
        inside = path.rstrip("/") + "/"
        return all(kind == "ends" or any(v.startswith(inside) or (kind == "starts" and inside.startswith(v)) for v in values) for kind, values in self.tests)


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """Paths of a folder's files that discovery takes, and of the folders in it that discovery enters.

    A link to a folder that holds it is a circle and isn't followed; a folder that went away, or may not be read, is empty.
    """
    files, folders = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    circle = entry.is_symlink() and (os.path.realpath(folder) + "/").startswith(os.path.realpath(entry.path) + "/")
                    if entry.name not in X.EXCLUDED_FOLDERS and not circle:
                        folders.append(entry.path)
                elif entry.is_file() and entry.name.endswith(_ENDINGS):
                    files.append(entry.path)
    except (FileNotFoundError, PermissionError):
        return [], []
    return sorted(files), sorted(folders)


def walk(part: Part, wanted: Wanted) -> Iterator[str]:
    """The paths of a partition's files."""
    open_folders = list(reversed(part.folders))
    while open_folders:
        files, folders = _entries(open_folders.pop())
        yield from (f for f in files if zlib.crc32(os.fsencode(f)) % part.parts == part.part and wanted.file(f))
        if part.deep:
            open_folders.extend(f for f in reversed(folders) if wanted.folder(f))


def _content(path: str) -> bytes | None:
    try:
        with open(path, "rb") as file:
            return file.read()
    except PermissionError:
        return None


def _opened(listed: Iterable[tuple[str, str]], opened: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of listed files (path, root) with their contents."""
    rows, held = [], 0
    for path, root in listed:
        content = None
        if opened:
            try:
                content = _content(path)
            except FileNotFoundError:  # it went away since it was listed
                continue
        rows.append((os.fsencode(path).decode("utf-8", "replace"), root, content))
        held += len(path) + len(content or b"")
        if held >= BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, str, bytes | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


class FilesReader(DataSourceReader):
    def __init__(self, root: str, spread: int, opened: bool) -> None:
        self.root, self.spread, self.opened, self.wanted = root, spread, opened, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return iter([f for f in filters if not self.wanted.take(f)])

    def partitions(self) -> list[Part]:
        """Folders from the root downwards, level by level, until there are `spread` of them; the last level's are walked as a whole."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        parts, held, n_held, listed, level = [], [], 0, 0, [self.root or "/"]
        while level and listed + len(level) < self.spread:
            deeper = []
            for folder in level:
                names, folders = _entries(folder)
                deeper += [f for f in folders if self.wanted.folder(f)]
                if len(names) > PART_FILES:
                    slices = -(-len(names) // PART_FILES)
                    parts += [Part((folder,), False, i, slices) for i in range(slices)]
                elif names:
                    if n_held + len(names) > PART_FILES:
                        parts.append(Part(tuple(held), False))
                        held, n_held = [], 0
                    held.append(folder)
                    n_held += len(names)
            listed, level = listed + len(level), deeper
        if held:
            parts.append(Part(tuple(held), False))
        parts += [Part((folder,), True, i, SLICES) for folder in level for i in range(SLICES)]
        return parts or [Part((self.root or "/",), False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        paths = walk(partition, self.wanted)
        yield from _opened(((path, self.root) for path in paths), self.opened)


class WorkspaceFiles(DataSource):
    """path, root and content of the files below a folder that discovery takes.

    Options: path (the folder), spread (how many folders to deal out, at least), opened (false: contents stay null and no file is opened).
    A file that may not be read has null content; one that vanishes is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace_files"

    def schema(self) -> str:
        return "path string, root string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"].rstrip("/"), int(self.options.get("spread", "64")), self.options.get("opened", "true") == "true")


def open_listed(listed: DataFrame) -> DataFrame:
    """path, root, content of listed files (path, root), opened where their rows are; files that went away are left out."""
    ship(listed.sparkSession)
    return listed.select("path", "root").mapInArrow(_open, "path string, root string, content binary")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _opened(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters on its path reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkspaceFiles)


def is_mounted(spark: SparkSession, root: str) -> bool:
    """Whether a path is in a file system that Python opens as well (file:)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
