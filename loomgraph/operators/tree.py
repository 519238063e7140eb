"""Directory trees as a flat table of nodes: Spark has no recursive type, and a tree is its prefixes.

Every file contributes its path and all prefixes of it; a node's place among its siblings is that of
the file that first showed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(files: DataFrame, path: str = "relative_path", order: str | None = None) -> DataFrame:
    """node, parent ('' at the root), name, depth, is_file, n_files and first (place of the first file under it).

    order: a column with each file's place; without it, files come in path order.
    """
    place = F.col(order) if order else F.col(path)
    parts = files.select(place.alias("place"), F.split(path, "/").alias("parts"))
    each = parts.select("place", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    parent = F.when(F.col("depth") == 1, "").otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/"))
    rows = each.select(prefix.alias("node"), parent.alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("parts")).alias("is_file"), "place")
    return rows.groupBy("node", "is_file").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.first("depth").alias("depth"), F.count("*").alias("n_files"), F.min("place").alias("first"))


def ranked(tree: DataFrame, folders_first: bool = True) -> DataFrame:
    """Adds ord, the place among siblings: folders before files, or both in the order of first sight."""
    keys = (["is_file"] if folders_first else []) + ["first", "is_file", "name"]
    return tree.withColumn("ord", F.row_number().over(Window.partitionBy("parent").orderBy(*keys)))


def children(tree: DataFrame, parent: str, folders_first: bool = True) -> DataFrame:
    """The children of one node in order."""
    own = tree.where(F.col("parent") == F.lit(parent))
    return ranked(own, folders_first).orderBy("ord")


def expand(tree: DataFrame, files: DataFrame, symbols: DataFrame, node: str, kind: str) -> DataFrame:
    """What opens under a node: of a folder its children, of a file its symbols by name, of a symbol nothing (kind, name, label columns)."""
    if kind == "dir":
        return children(tree, node).select(F.when(F.col("is_file"), "file").otherwise("dir").alias("kind"), "name", F.col("name").alias("label"), F.col("ord").cast("long").alias("ord"))
    if kind == "file":
        own = files.where(F.col("relative_path") == F.lit(node)).select(F.col("id").alias("file_id"))
        found = symbols.join(own, "file_id")
        order = Window.partitionBy(F.lit(1)).orderBy("name", "range.start_line")
        return found.select(F.lit("symbol").alias("kind"), "name", F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias("label"), F.row_number().over(order).cast("long").alias("ord"))
    return tree.where("false").select(F.lit("").alias("kind"), "name", F.col("name").alias("label"), F.lit(0).cast("long").alias("ord"))
