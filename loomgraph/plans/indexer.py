"""The engine's facade: index files or a workspace into a store, and read it."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as X
from loomgraph.operators import readmodel as R
from loomgraph.operators.delta import ADDED, CHANGED, REMOVED, below, difference
from loomgraph.operators.extract import extract_files
from loomgraph.operators.textindex import SymbolIndex
from loomgraph.operators.upsert import Store
from loomgraph.session import cut, discard, scratch
from loomgraph.sources import workspace as W

LOG = logging.getLogger("loomgraph")
#: How often a run's counter of files is looked at.
WATCH_SECONDS = 0.2
#: Changed paths of an incremental run that are named in the second reading's filter, so that the source opens no other file.
NAMED_PATHS = 1_000


@dataclass(frozen=True)
class IndexResult:
    """What indexing one file gave."""

    relative_path: str
    symbol_count: int
    elapsed_ms: int
    symbols: list
    message: str


@dataclass(frozen=True)
class WorkspaceResult:
    indexed: int
    failed: int
    summary: str
    elapsed_ms: int
    removed: int = 0
    cancelled: bool = False


class Indexer:
    """Opens its store at the first use; a failed opening is tried again at the next one."""

    def __init__(self, spark: SparkSession, path: str | None = None, on_indexed: Callable[[], None] | None = None) -> None:
        """Without a path the store goes when the application ends. on_indexed is called after each successful run, for views that show the store."""
        self.spark, self.path, self.on_indexed, self._store = spark, path, on_indexed, None
        self._tag, self._stopped = f"index-{uuid.uuid4().hex}", False

    def initialize(self) -> None:
        if self._store is None:
            if self.path is None:
                self._store = Store.in_memory(self.spark)
                return
            store = Store(self.spark, self.path)
            store.initialize()
            self._store = store

    @property
    def store(self) -> Store:
        if self._store is None:
            raise RuntimeError("the indexer isn't initialised, or was disposed")
        return self._store

    def dispose(self) -> None:
        self._store = None

    # -- writing

    def _index(self, sources: DataFrame, removed: DataFrame | None = None, counter: Accumulator | None = None) -> DataFrame | None:
        """The extracted files, committed together with the removal of other paths; None if there are no files. Of files that sources name twice the last one by seq counts."""
        extracted = cut(extract_files(sources, counter), "extracted")
        none = extracted.isEmpty()
        if not none or removed is not None:
            self.store.replace_files(extracted.where("error is null").drop("error"), removed)
        return None if none else extracted

    def index_file(self, path: str, root: str) -> IndexResult:
        began = time.time()
        self.initialize()
        extracted = self._index(W.single_files(self.spark, [path], root))
        first = extracted.select("relative_path", "error").first()
        if first["error"] is not None:
            raise ValueError(first["error"])
        relative = first["relative_path"]
        symbols = self.get_symbols(relative).collect()
        label = None if not symbols else f"{symbols[0]['name']} ({symbols[0]['kind'][:1].upper()}{symbols[0]['kind'][1:]})"
        message = f"found 0 symbols in {relative}." if label is None else f"found: {label}"
        LOG.debug("indexed %s: %d symbols", relative, len(symbols))
        if self.on_indexed is not None:
            self.on_indexed()
        return IndexResult(relative, len(symbols), int(1000 * (time.time() - began)), symbols, message)

    def cancel(self) -> None:
        """Stops the run that is under way, from another thread: its jobs are interrupted, and the part in work isn't committed."""
        self._stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def index_sources(
        self,
        sources: DataFrame,
        batches: int = 1,
        progress: Callable[[int, int], None] | None = None,
        cancelled: Callable[[], bool] | None = None,
        removed: DataFrame | None = None,
        on_files: Callable[[int], None] | None = None,
    ) -> WorkspaceResult:
        """Indexes all sources; a file that fails is counted and leaves the others alone.

        Each of `batches` parts (by a hash of the path) is a transaction of its own. Before each, progress
        is told the part and the parts, and cancelled may stop the run: what was committed stays. `cancel` stops it within a part.
        on_files is told, from a thread of its own, how many files were scanned so far each time that tasks have ended, and after
        each part how many files were handled, of any language. Sources are read once; with several parts they are staged in
        shared storage, a folder a part. Paths of `removed` go with the first part's transaction.
        """
        began = time.time()
        self._stopped = False
        self.initialize()
        counts = {"indexed": 0, "failed": 0}
        self.spark.sparkContext.addJobTag(self._tag)
        try:
            self._parts(sources, batches, progress, cancelled, removed, on_files, counts)
        except Exception:
            if not self._stopped:  # else the jobs failed because they were interrupted
                raise
            LOG.info("indexing was cancelled")
        finally:
            self.spark.sparkContext.removeJobTag(self._tag)
        if self.on_indexed is not None:
            self.on_indexed()
        return WorkspaceResult(counts["indexed"], counts["failed"], R.summary_line(counts["indexed"], counts["failed"]), int(1000 * (time.time() - began)), cancelled=self._stopped)

    def _parts(self, sources: DataFrame, batches: int, progress, cancelled, removed: DataFrame | None, on_files, counts: dict[str, int]) -> None:
        if batches > 1:
            staged = scratch(self.spark, "parts")
            sources.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int")).write.partitionBy("part").parquet(staged)
            parts = self.spark.read.schema(T.StructType([*sources.schema.fields, T.StructField("part", T.IntegerType())])).parquet(staged)
        for part in range(batches):
            self._stopped = self._stopped or (cancelled is not None and cancelled())
            if self._stopped:
                break
            if progress is not None:
                progress(part + 1, batches)
            own = sources if batches == 1 else parts.where(F.col("part") == part).drop("part")
            with self._watched(on_files, sum(counts.values())) as counter:
                extracted = self._index(own, removed if part == 0 else None, counter)
            if extracted is None:
                continue
            # the part is committed, so its counts are taken even if the run is cancelled now
            self.spark.sparkContext.removeJobTag(self._tag)
            for row in extracted.where("error is not null").select("path", "error").limit(100).collect():
                LOG.error("failed to index %s: %s", row["path"], row["error"])
            told = R.summary(extracted).first()
            counts["indexed"], counts["failed"] = counts["indexed"] + told["indexed"], counts["failed"] + told["failed"]
            discard(extracted)
            self.spark.sparkContext.addJobTag(self._tag)
            if on_files is not None:
                on_files(sum(counts.values()))

    @contextmanager
    def _watched(self, on_files: Callable[[int], None] | None, before: int) -> Iterator[Accumulator | None]:
        """A counter of scanned files; while the block runs, on_files is told of its growth."""
        if on_files is None:
            yield None
            return
        counter, done = self.spark.sparkContext.accumulator(0), threading.Event()

        def watch() -> None:
            told = 0
            while not done.wait(WATCH_SECONDS):
                if counter.value > told:
                    told = counter.value
                    on_files(before + told)

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield counter
        finally:
            done.set()
            thread.join()

    def index_workspace(self, root: str, **options) -> WorkspaceResult:
        return self.index_sources(W.workspace(self.spark, root), **options)

    def index_incremental(self, sources: DataFrame, complete: bool = False, root: str | None = None, **options) -> WorkspaceResult:
        """Indexes only the files whose text isn't the stored one.

        complete: sources are all that there is below root (or below the roots that sources name), so stored files below it that
        sources don't have are removed, with their symbols and edges, in the transaction of the first part. Files of other folders stay.
        """
        self.initialize()
        stored = self.store.read("file").select("path", "hash")
        hashed = sources.withColumn("hash", X.content_hash(X.decoded(F.col("content"))))
        changes = cut(difference(stored, hashed.select("path", "hash")), "changes")
        wanted = changes.where(F.col("change").isin(ADDED, CHANGED)).select("path")
        removed = None
        if complete:
            roots = [root] if root is not None else [r[0] for r in sources.select("root").distinct().collect()]  # the folders of a workspace
            inside = reduce(Column.__or__, [below(F.col("path"), r) for r in roots], F.lit(False))
            removed = changes.where(F.col("change") == REMOVED).where(inside).select("path")
        n_removed = 0 if removed is None else removed.count()
        named = [r["path"] for r in wanted.limit(NAMED_PATHS + 1).collect()]
        chosen = hashed.where(F.col("path").isin(named)) if len(named) <= NAMED_PATHS else hashed.join(wanted, "path", "left_semi")
        result = self.index_sources(chosen.select("path", "root", "content"), removed=removed if n_removed else None, **options)
        discard(changes)
        return replace(result, removed=n_removed)

    def index_workspace_incremental(self, root: str, **options) -> WorkspaceResult:
        """The workspace as it is now: changed files are indexed, and those that vanished leave the graph."""
        return self.index_incremental(W.workspace(self.spark, root), complete=True, root=W.local_root(root), **options)

    # -- reading

    def get_all_files(self) -> DataFrame:
        return R.all_files(self.store.read("file"))

    def find_file_id(self, path: str) -> str | None:
        row = self.store.lookup("file", "path", path).select("id").orderBy("id").first()
        return None if row is None else row["id"]

    def views(self, prefix: str = "") -> list[str]:
        """Makes the current snapshot's tables temporary views for SQL; their names."""
        for name, df in self.store.snapshot().items():
            df.createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in self.store.tables()]

    def get_symbols(self, relative_path: str) -> DataFrame:
        tables = self.store.snapshot()
        return R.symbols_for_file(tables["file"], tables["symbol"], relative_path)

    def search(self, words: str, most: int = 20, misspelt: bool = False) -> DataFrame:
        """The best symbols for the words, through the stored index, which is brought up to the store first."""
        index = SymbolIndex(self.store)
        index.refresh()
        return index.search_misspelt(words, most) if misspelt else index.search(words, most)

    def get_files_with_symbols(self, root: str | None = None) -> DataFrame:
        tables = self.store.snapshot()
        return R.files_with_symbols(tables["file"], tables["symbol"], root)
