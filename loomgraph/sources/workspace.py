"""Sources: a folder of files, single files, and a table of (path, content)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.sources.files import is_mounted, open_listed, register

SOURCES = "path string, root string, content binary"
#: The path of a listed file without its scheme, as roots are written.
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)"


def local_path(path: str = "path"):
    return F.regexp_replace(path, _SCHEME, "")


def local_root(root: str) -> str:
    base = root.split("://", 1)[-1] if "://" in root else root
    return (base if base.startswith("/") else "/" + base.split("/", 1)[-1]).rstrip("/")


def listing(spark: SparkSession, root: str, included: tuple[str, ...] = X.INCLUDED) -> DataFrame:
    """path (as the file system names it) and root of every file under root that discovery takes; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(included)}}}").load(root)
    return taken(files.select("path"), local_root(root))


def taken(paths: DataFrame, root: str) -> DataFrame:
    named = paths.select("path", F.lit(root).alias("root"))
    return named.where(X.in_workspace(X.relative_path(F.col("root"), local_path(), outside=False)))


def contents(listed: DataFrame) -> DataFrame:
    """path, root, content of listed files.

    Only these files are opened: by the tasks that hold their paths, where the workers can (and one that has gone since is left
    out), else by Spark's file source, for which the driver holds the paths.
    """
    spark = listed.sparkSession
    some = listed.select("path").first()
    if some is not None and is_mounted(spark, some["path"]):
        return open_listed(listed.select(local_path().alias("path"), "root").distinct())
    rows = listed.distinct().collect()
    out = spark.createDataFrame([], SOURCES)
    for root in sorted({r["root"] for r in rows}):
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in rows if r["root"] == root]  # a path isn't a pattern
        files = spark.read.format("binaryFile").load(sorted(paths))
        out = out.unionByName(files.select(local_path().alias("path"), F.lit(root).alias("root"), "content"))
    return out


def workspace(spark: SparkSession, root: str, included: tuple[str, ...] = X.INCLUDED) -> DataFrame:
    """path, root, content of every file under root that discovery takes: listed, filtered, and only then opened.

    Where the workers can open the folder themselves, its partitions are listed and read by them (`files`); in other file
    systems Spark lists the paths, which leaves out names that begin with a dot or an underscore.
    """
    if not is_mounted(spark, root):
        return contents(listing(spark, root, included))
    register(spark)
    spread = str(2 * spark.sparkContext.defaultParallelism)
    files = spark.read.format("workspace_files").option("spread", spread).load(local_root(root))
    endings = f"[.]({'|'.join(included)})$"
    return files if included == X.INCLUDED else files.where(F.col("path").rlike(endings))


def single_files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """path, root, content of the named files; they may lie outside root. One that isn't there is an error."""
    if all(is_mounted(spark, p) for p in paths):
        gone = [p for p in paths if not os.path.isfile(local_root(p))]
        if gone:
            raise FileNotFoundError(f"no file {gone[0]}")
        named = spark.createDataFrame([(local_root(p), root.rstrip("/")) for p in paths], "path string, root string")
        return open_listed(named)
    files = spark.read.format("binaryFile").load(paths)
    return files.select(local_path().alias("path"), F.lit(root.rstrip("/")).alias("root"), "content")


def table_of_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """A table that holds paths and contents (text or bytes) as a source."""
    return df.select(F.col(path).alias("path"), F.lit(root.rstrip("/")).alias("root"), F.col(content).cast("binary").alias("content"))
