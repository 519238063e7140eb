"""Streaming: a folder of files indexed as they come, and view messages folded as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import text as X
from loomgraph.plans.indexer import Indexer
from loomgraph.sources import workspace as W

MESSAGES = "seq long, panel string, type string, n_files long, payload string"


def file_stream(spark: SparkSession, root: str, most_files: int = 10_000) -> DataFrame:
    """path and root of every file that discovery takes, as it appears under root: at most most_files a micro-batch, and no content yet."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    options = {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{{{','.join(X.INCLUDED)}}}", "maxFilesPerTrigger": str(most_files)}
    return W.taken(reader.options(**options).load(root).select("path"), W.local_root(root))


def index_stream(indexer: Indexer, sources: DataFrame, checkpoint: str, after: Callable[[DataFrame], None] | None = None, incremental: bool = True) -> StreamingQuery:
    """Indexes each micro-batch in one transaction; `after` gets the files with their symbols then.

    A batch that is replayed after a failure replaces the same files by the same rows.
    """
    indexer.initialize()

    def batch(df: DataFrame, number: int) -> None:
        df = df if "content" in df.columns else W.contents(df)
        if df.isEmpty():
            return
        (indexer.index_incremental if incremental else indexer.index_sources)(df)
        if after is not None:
            after(indexer.get_files_with_symbols())

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_json(path: str) -> Callable[[DataFrame], None]:
    """A sink for `after`: one JSON message with all files, the newest replacing the one before."""

    def push(files: DataFrame) -> None:
        files.select(F.lit("symbols").alias("type"), "path", "relative_path", "symbols").write.mode("overwrite").json(path)

    return push


def view_states(messages: DataFrame) -> DataFrame:
    """The running state of each panel's view: loading until a `symbols` message comes, then empty or loaded by the last."""
    shown = F.when(F.col("type") == "symbols", F.col("seq"))
    grouped = messages.groupBy("panel").agg(F.max_by("n_files", shown).alias("n_files"), F.count_if(F.col("type") == "symbols").alias("n"))
    return grouped.select("panel", F.when(F.col("n") == 0, "loading").when(F.col("n_files") == 0, "empty").otherwise("loaded").alias("state"))
