"""Queries and read models over file and symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def all_files(files: DataFrame) -> DataFrame:
    """id, relative_path, language of every file in path order."""
    return files.select("id", "relative_path", "language").orderBy("relative_path", "id")


def symbols_for_file(files: DataFrame, symbols: DataFrame, relative_path: str) -> DataFrame:
    """The symbols of the files of this relative path in name order; an unknown path gives none.

    The path is filtered before the join, so its side is as small as the files of one path.
    """
    own = files.where(F.col("relative_path") == F.lit(relative_path)).select(F.col("id").alias("file_id"))
    found = symbols.join(own, "file_id").select("id", "fqn", "name", "kind", "file_id", "range", "language")
    return found.orderBy("name", "range.start_line", "range.start_col")


def files_with_symbols(files: DataFrame, symbols: DataFrame, root: str | None = None) -> DataFrame:
    """path, relative_path and the array of (name, kind, start_line) of every file, in one join: files without symbols keep an empty array.

    Symbols belong to a relative path: files that share one show the union.
    """
    named = symbols.join(files.select(F.col("id").alias("file_id"), "relative_path"), "file_id")
    nested = named.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("name", F.col("range.start_line").alias("start_line"), F.col("range.start_col").alias("start_col"), "kind"))).alias("all"))
    slim = F.transform(F.coalesce("all", F.array().cast("array<struct<name:string,start_line:bigint,start_col:bigint,kind:string>>")), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["start_line"].alias("start_line")))
    joined = files.select("id", "relative_path").join(nested, "relative_path", "left")
    return joined.select(X.absolute_path(F.lit(root), F.col("relative_path")).alias("path"), "relative_path", slim.alias("symbols")).orderBy("relative_path")


def first_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """relative_path and the label of the first symbol by name (null: none) of every file."""
    order = F.struct("name", F.col("range.start_line"), F.col("range.start_col"))
    first = symbols.groupBy("file_id").agg(F.min_by(X.titled_label(F.col("name"), F.col("kind")), order).alias("label"), F.count("*").alias("n_symbols"))
    return files.select(F.col("id").alias("file_id"), "relative_path").join(first, "file_id", "left").select("relative_path", "label", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def found_message(relative_path: Column, label: Column) -> Column:
    """What an index run tells about a file."""
    return F.when(label.isNull(), F.concat(F.lit("found 0 symbols in "), relative_path, F.lit("."))).otherwise(F.concat(F.lit("found: "), label))


def summary(results: DataFrame) -> DataFrame:
    """indexed, failed and the summary line of a run (rows with a null error were indexed)."""
    counts = results.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    text = F.when(F.col("failed") > 0, F.concat(F.lit("Indexed "), F.col("indexed").cast("string"), F.lit(" files ("), F.col("failed").cast("string"), F.lit(" failed)."))).otherwise(F.concat(F.lit("Indexed "), F.col("indexed").cast("string"), F.lit(" files.")))
    return counts.withColumn("summary", text)


def summary_line(indexed: int, failed: int) -> str:
    return f"Indexed {indexed} files ({failed} failed)." if failed else f"Indexed {indexed} files."


def symbol_items(symbols: DataFrame) -> DataFrame:
    """Label, icon and line of every symbol as a tree shows it."""
    return symbols.select("file_id", "name", X.symbol_label(F.col("name"), F.col("kind")).alias("label"), X.icon(F.col("kind")).alias("icon"), X.line_of(F.col("range.start_line")).alias("line"))


def view_state(messages: DataFrame, key: str | None = None) -> DataFrame:
    """The view's state after messages (seq, type, n_files): the last `symbols` message decides; others change nothing; none: loading."""
    last = F.max_by(F.when(F.col("type") == "symbols", F.col("n_files")), F.when(F.col("type") == "symbols", F.col("seq")))
    grouped = messages.groupBy(*([key] if key else [])).agg(last.alias("n_files"), F.count_if(F.col("type") == "symbols").alias("n_symbols_messages"))
    state = F.when(F.col("n_symbols_messages") == 0, "loading").when(F.col("n_files") == 0, "empty").otherwise("loaded")
    return grouped.withColumn("state", state)


def last_payloads(messages: DataFrame, key: str) -> DataFrame:
    """The replay cache: each panel's last payload, cleared by a later `closed`."""
    order = Window.partitionBy(key).orderBy(F.desc("seq"))
    last = messages.where(F.col("type").isin("symbols", "closed")).withColumn("_n", F.row_number().over(order)).where("_n = 1 and type = 'symbols'")
    return last.select(key, "seq", "payload")
