"""From a place in a file to the symbol around it, and from a call to what it calls.

Ranges and places meet in an equi-join on (file, level, cell): a range of n lines lies in one or two cells of 2^level >= n
lines, and a place in one cell of each level that is there. Levels go by STEP, so that short ranges share one. So a range gives
two rows at most, however long it is, a place one for each level (16 at most), and a file of many places is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

#: Levels from one to the next: a cell has 16 lines at the first, and 16 times the last one's at each further one.
STEP = 4


def _start() -> Column:
    return F.struct("range.start_line", "range.start_col")


def _usable(ranges: DataFrame) -> DataFrame:
    """id, file_id, start, end of ranges that are whole and not empty the wrong way round."""
    known = ranges.select("id", "file_id", _start().alias("start"), F.struct("range.end_line", "range.end_col").alias("end"))
    whole = [F.col(c).isNotNull() for c in ("start.start_line", "start.start_col", "end.end_line", "end.end_col")]
    return known.where(whole[0] & whole[1] & whole[2] & whole[3]).where((F.col("start.start_line") < F.col("end.end_line")) | ((F.col("start.start_line") == F.col("end.end_line")) & (F.col("start.start_col") <= F.col("end.end_col"))))


def _celled(ranges: DataFrame) -> DataFrame:
    lines = F.col("end.end_line") - F.col("start.start_line") + 1
    bits = F.length(F.bin(F.greatest(lines - 1, F.lit(0))))
    level = F.least(STEP * F.ceil(bits / STEP), F.lit(63)).cast("int")  # a shift by 64 is none
    shifted = ranges.withColumn("level", level)
    first, last = (F.expr(f"shiftright({c}, level)") for c in ("start.start_line", "end.end_line"))
    return shifted.withColumn("cell", F.explode(F.array_distinct(F.array(first, last))))


def enclosing(places: DataFrame, ranges: DataFrame, proper: bool = False) -> DataFrame:
    """place, symbol_id: for each place (place, file_id, line, col) the innermost range (id, file_id, range) around it, null if there is none.

    Of several ranges the one that begins last is innermost, then the one that ends first, then the least id; both ends belong to a range.
    proper: places are ranges' own beginnings with their `end`, and a range counts only if it holds the whole and is larger.
    """
    celled = _celled(_usable(ranges))
    levels = sorted(r[0] for r in celled.select("level").distinct().collect())  # 16 at most
    if not levels:
        return places.select("place", F.lit(None).cast(ranges.schema["id"].dataType).alias("symbol_id"))
    spread = places.where("line is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("cell", F.expr("shiftright(line, level)"))
    own = spread.withColumns({"at_line": F.col("line"), "at_col": F.coalesce("col", F.lit(0))}).drop("line", "col")
    if proper:
        own = own.withColumnRenamed("end", "at_end")
    met = own.join(celled, ["file_id", "level", "cell"])
    begins = (F.col("start.start_line") < F.col("at_line")) | ((F.col("start.start_line") == F.col("at_line")) & (F.col("start.start_col") <= F.col("at_col")))
    last = F.struct(F.col("at_line").alias("end_line"), F.col("at_col").alias("end_col")) if not proper else F.col("at_end")
    holds = begins & (last <= F.col("end"))
    if proper:
        holds = holds & ~((F.col("end") == last) & (F.col("start.start_line") == F.col("at_line")) & (F.col("start.start_col") == F.col("at_col")))
    order = F.struct((-F.col("start.start_line")).alias("a"), (-F.col("start.start_col")).alias("b"), F.col("end"), F.col("id"))
    inner = met.where(holds).groupBy("place").agg(F.min(order).alias("inner")).select("place", F.col("inner.id").alias("symbol_id"))
    return places.select("place").join(inner, "place", "left")


def parents(symbols: DataFrame) -> DataFrame:
    """id, parent_id: the innermost symbol that holds a symbol and is larger, null at the top of a file."""
    places = _usable(symbols).select(F.col("id").alias("place"), "file_id", F.col("start.start_line").alias("line"), F.col("start.start_col").alias("col"), "end")
    return enclosing(places, symbols, proper=True).select(F.col("place").alias("id"), F.col("symbol_id").alias("parent_id"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, caller_symbol_id, callee_symbol_id of calls (id, file_id, line, col, callee: a name).

    The caller is the innermost symbol around the call. The callee is the symbol of that name that is visible there:
    of the same file's, declared at the top or within a symbol that holds the call, the one of the innermost scope
    (then the last to begin, then the least id); else the only top-level symbol of that name in other files; else null.
    """
    # each step is written, so that the shuffle files of one are there at a time
    caller = cut(enclosing(calls.withColumnRenamed("id", "place"), symbols).select(F.col("place").alias("id"), F.col("symbol_id").alias("caller_symbol_id")), "callers")
    up = cut(parents(symbols), "parents")
    bounds = _usable(symbols).select(F.col("id").alias("parent_id"), F.col("start").alias("scope_start"), F.col("end").alias("scope_end"))
    declared = symbols.select("id", "name", "file_id", _start().alias("start")).join(up, "id", "left").join(bounds, "parent_id", "left").withColumnRenamed("id", "symbol_id")
    at = F.struct(F.col("line").alias("start_line"), F.coalesce("col", F.lit(0)).alias("start_col"))
    last = F.struct(F.col("line").alias("end_line"), F.coalesce("col", F.lit(0)).alias("end_col"))
    named = calls.select("id", "file_id", "line", "col", F.col("callee").alias("name"))
    near = named.join(declared, ["file_id", "name"]).where(F.col("parent_id").isNull() | ((F.col("scope_start") <= at) & (last <= F.col("scope_end"))))
    depth = F.struct(F.col("parent_id").isNotNull().alias("inner"), "scope_start", "start")
    # the greatest of these, and of equal ones the least id
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(depth.desc(), F.asc("symbol_id"))))
    local = cut(ranked.where("n = 1").select("id", F.col("symbol_id").alias("local_id")), "callees")
    only = declared.where("parent_id is null").groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("global_id")).where("n = 1").drop("n")
    out = calls.select("id", F.col("callee").alias("name")).join(caller, "id", "left").join(local, "id", "left").join(only, "name", "left")
    return out.select("id", "caller_symbol_id", F.coalesce("local_id", "global_id").alias("callee_symbol_id"))


def diagnostics_of_symbols(diagnostics: DataFrame, symbols: DataFrame) -> DataFrame:
    """The diagnostics (id, file_id, range, ...) with symbol_id: the innermost symbol around where each begins."""
    places = diagnostics.select(F.col("id").alias("place"), "file_id", F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"))
    found = enclosing(places, symbols).withColumnRenamed("place", "id")
    return diagnostics.drop("symbol_id").join(found, "id", "left")
