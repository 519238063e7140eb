"""Places to symbols, calls to callees: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import positions as P

RANGE = "struct<start_line: long, start_col: long, end_line: long, end_col: long>"


def inner(at, file_id, ranges):
    held = [(-r[0], -r[1], (r[2], r[3]), i) for i, f, r in ranges if f == file_id and r and None not in r and (r[0], r[1]) <= at <= (r[2], r[3])]
    return min(held)[3] if held else None


@pytest.fixture(scope="module")
def nested():
    draw = random.Random(3)
    ranges = [("whole", "a", (0, 0, 5000, 9)), ("none", "a", None), ("half", "a", (1, None, 3, 3)), ("turned", "a", (9, 0, 3, 0)), ("same-1", "b", (5, 1, 9, 1)), ("same-2", "b", (5, 1, 9, 1))]
    for i in range(300):
        a = draw.randrange(3000)
        ranges.append((f"s{i:03}", draw.choice("aab"), (a, draw.randrange(4), a + draw.choice([0, 1, 3, 40, 700]), draw.randrange(4, 9))))
    places = [(i, draw.choice("aaabc"), draw.randrange(3100), draw.randrange(8)) for i in range(500)] + [(900, None, 3, 3), (901, "a", None, 1), (902, "b", 7, None)]
    return ranges, places


def frames(spark, nested):
    ranges, places = nested
    return spark.createDataFrame(places, "place long, file_id string, line long, col long"), spark.createDataFrame(ranges, f"id string, file_id string, range {RANGE}")


def test_innermost(spark, nested):
    places, ranges = frames(spark, nested)
    got = {r["place"]: r["symbol_id"] for r in P.enclosing(places, ranges).collect()}
    assert got == {p: None if line is None else inner((line, col or 0), f, nested[0]) for p, f, line, col in nested[1]}
    assert P.enclosing(places, ranges.where("false")).where("symbol_id is not null").count() == 0
    assert P.enclosing(places.where("false"), ranges).count() == 0


def test_parents(spark, nested):
    _, ranges = frames(spark, nested)
    got = {r["id"]: r["parent_id"] for r in P.parents(ranges).collect()}
    usable = [(i, f, r) for i, f, r in nested[0] if r and None not in r and r[:2] <= r[2:]]
    for i, f, r in usable:
        held = [(-p[0], -p[1], p[2:], j) for j, g, p in usable if g == f and p != r and p[:2] <= r[:2] and r[2:] <= p[2:]]
        assert got[i] == (min(held)[3] if held else None)


def test_no_join_on_inequality_alone(spark, nested):
    plan = P.enclosing(*frames(spark, nested))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_long_file_of_many_places(spark):
    """One file with 40,000 places and a range of 100,000 lines around all: two rows for the range, one for each level and place."""
    places = spark.range(40000).select(F.col("id").alias("place"), F.lit("f").alias("file_id"), (F.col("id") * 2).alias("line"), F.lit(0).cast("long").alias("col"))
    ranges = spark.createDataFrame([("all", "f", (0, 0, 100000, 0)), ("ten", "f", (10, 0, 19, 0))], f"id string, file_id string, range {RANGE}")
    assert P._celled(P._usable(ranges)).count() <= 4
    assert {(r["symbol_id"], r["count"]) for r in P.enclosing(places, ranges).groupBy("symbol_id").count().collect()} == {("all", 39995), ("ten", 5)}


def test_scopes(spark):
    """The same name at the top, in a function and in another file."""
    symbols = spark.createDataFrame(
        [
            ("a.outer", "outer", "a", (0, 0, 20, 1)), ("a.outer.help", "help", "a", (2, 0, 5, 1)), ("a.help", "help", "a", (30, 0, 31, 1)), ("a.outer.in", "in", "a", (6, 0, 12, 1)), ("a.outer.in.help", "help", "a", (7, 0, 7, 9)),
            ("b.help", "help", "b", (0, 0, 1, 1)), ("b.only", "only", "b", (3, 0, 4, 1)), ("c.twice", "twice", "c", (0, 0, 0, 9)), ("d.twice", "twice", "d", (0, 0, 0, 9)), ("b.box", "box", "b", (10, 0, 20, 0)), ("b.box.hidden", "hidden", "b", (11, 0, 12, 0)),
        ],
        f"id string, name string, file_id string, range {RANGE}",
    )
    calls = [("1", "a", 8, 1, "help", "a.outer.in", "a.outer.in.help"), ("2", "a", 15, 0, "help", "a.outer", "a.outer.help"), ("3", "a", 40, 0, "help", None, "a.help"), ("4", "a", 40, 0, "only", None, "b.only"), ("5", "a", 1, 0, "twice", "a.outer", None), ("6", "c", 0, 2, "hidden", "c.twice", None), ("7", "b", 11, 4, "hidden", "b.box.hidden", "b.box.hidden"), ("8", None, 1, 1, "only", None, "b.only"), ("9", "a", 1, 1, None, "a.outer", None)]
    df = spark.createDataFrame([c[:5] for c in calls], "id string, file_id string, line long, col long, callee string")
    got = {r["id"]: (r["caller_symbol_id"], r["callee_symbol_id"]) for r in P.resolve_calls(df, symbols).collect()}
    assert got == {c[0]: c[5:] for c in calls}


def test_steps_of_calls_are_written(spark):
    """The last join alone is left to shuffle: the steps before it are tables."""
    calls = spark.range(3).selectExpr("'c' || id as id", "'f' as file_id", "id as line", "0L as col", "'a' as callee")
    symbols = spark.range(3).selectExpr("'s' || id as id", "'a' as name", "'f' as file_id", "named_struct('start_line', id, 'start_col', 0L, 'end_line', id + 1, 'end_col', 0L) as range")
    plan = P.resolve_calls(calls, symbols)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 6


def test_short_ranges_share_a_level(spark):
    """A place is written once for each level, so ranges of up to 16 lines, as most are, have one; what is found stays that of every pair."""
    ranges = [(f"r{i:03}", f"f{i % 3}", (7 * i) % 400, (7 * i) % 400 + (i * i) % (3, 16, 40, 5000)[i % 4]) for i in range(300)] + [("far", "f0", 0, 2**62)]
    rows = spark.createDataFrame([(i, f, (a, 0, b, 0)) for i, f, a, b in ranges], "id string, file_id string, range struct<start_line: long, start_col: long, end_line: long, end_col: long>")
    levels = lambda df: sorted(r[0] for r in P._celled(P._usable(df)).select("level").distinct().collect())
    assert levels(rows.where("range.end_line - range.start_line < 16")) == [4]
    assert levels(rows) == [4, 8, 12, 16, 63]
    places = [(f"p{i}", f"f{i % 3}", 11 * i % 450, 0) for i in range(120)]
    found = P.enclosing(spark.createDataFrame(places, "place string, file_id string, line long, col long"), rows)
    expected = {p: min(((-a, b, i) for i, g, a, b in ranges if g == f and (a, 0) <= (line, 0) <= (b, 0)), default=(0, 0, None))[2] for p, f, line, _ in places}
    assert {r["place"]: r["symbol_id"] for r in found.collect()} == expected
