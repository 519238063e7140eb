"""Expressions, read models, trees, validation and the traversals, on small tables."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import schema as S
from loomgraph.functions import text as X
from loomgraph.operators import graph as G
from loomgraph.operators import readmodel as R
from loomgraph.operators import tree as T
from loomgraph.operators import validate as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("path, expected", [("/a/b.ts", "typescript"), ("/a/B.TS", "typescript"), ("b.d.ts", "typescript"), ("/a/.ts", "plaintext"), ("x.mjs", "javascript"), ("x.jsx", "javascriptreact"), ("x.md", "markdown"), ("x.", "plaintext"), ("x", "plaintext"), ("x.ts/y", "plaintext")])
def test_language(spark, path, expected):
    assert one(spark, X.language(F.lit(path))) == expected


def test_text(spark):
    assert one(spark, X.line_count(F.lit(""))) == 1
    assert one(spark, X.line_count(F.lit("a\nb\n"))) == 3
    assert one(spark, X.decoded(F.lit(b"a\xe2\x28\xa1"))) == b"a\xe2\x28\xa1".decode(errors="replace")


@pytest.mark.parametrize("path, expected", [("/w/a/b.ts", "a/b.ts"), ("/w", ""), ("/v/c.ts", "../v/c.ts"), ("/wx/c.ts", "../wx/c.ts"), ("/w/../v//./c.ts", "../v/c.ts"), ("/w/a/../b.ts", "b.ts"), ("/", "..")])
def test_relative_path(spark, path, expected):
    assert one(spark, X.relative_path(F.lit("/w"), F.lit(path))) == expected


@pytest.mark.parametrize("root, path", [("/a/b/c", "/a/x/y.ts"), ("/a/b", "/a/b/c/../../d.ts"), ("/a/b/", "/a"), ("/a", "/b"), ("/", "/x/y")])
def test_relative_path_as_the_system_has_it(spark, root, path):
    import posixpath

    assert one(spark, X.relative_path(F.lit(root), F.lit(path))) == posixpath.relpath(path, root)
    relative = posixpath.relpath(path, root)
    assert one(spark, X.absolute_path(F.lit(root), F.lit(relative))) == posixpath.normpath(path)


def test_paths_never_leave_the_jvm(spark):
    plan = spark.createDataFrame([("/w", "/w/a.ts")], "root string, path string").select(X.relative_path(F.col("root"), F.col("path")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("path, expected", [("a.ts", True), ("node_modules/a.ts", False), ("x/dist/a.js", False), ("distant/a.js", True), ("a.txt", False), ("b/.git/c.md", False)])
def test_workspace(spark, path, expected):
    assert one(spark, X.in_workspace(F.lit(path))) is expected


def tables(spark):
    files = spark.createDataFrame([("1", "src/z.ts", "typescript"), ("2", "src/a.ts", "typescript"), ("3", "r.md", "markdown"), ("4", "src/a.ts", "typescript")], "id string, relative_path string, language string")
    rows = [("s1", "f", "b", "function", "1", (3, 0, 4, 1)), ("s2", "f", "B", "class", "1", (1, 0, 1, 5)), ("s3", "f", "a", "enum", "2", (0, 0, 0, 1)), ("s4", "f", "c", "type", "4", (0, 0, 0, 1))]
    symbols = spark.createDataFrame([(*r[:5], dict(zip(S.RANGE_FIELDS, r[5])), "typescript") for r in rows], "id string, fqn string, name string, kind string, file_id string, range struct<start_line:long,start_col:long,end_line:long,end_col:long>, language string")
    return files, symbols


def test_reads(spark):
    files, symbols = tables(spark)
    assert [r["relative_path"] for r in R.all_files(files).collect()] == ["r.md", "src/a.ts", "src/a.ts", "src/z.ts"]
    assert [r["name"] for r in R.symbols_for_file(files, symbols, "src/z.ts").collect()] == ["B", "b"]
    assert [r["name"] for r in R.symbols_for_file(files, symbols, "src/a.ts").collect()] == ["a", "c"]  # both files of that path
    assert R.symbols_for_file(files, symbols, "none").collect() == []
    nested = {(r["relative_path"], len(r["symbols"])) for r in R.files_with_symbols(files, symbols, "/w").collect()}
    assert nested == {("r.md", 0), ("src/a.ts", 2), ("src/z.ts", 2)}
    labels = {r["relative_path"]: r["label"] for r in R.first_symbols(files, symbols).collect()}
    assert labels["r.md"] is None and labels["src/z.ts"] == "B (Class)"


def test_symbol_items(spark):
    _, symbols = tables(spark)
    got = {(r["label"], r["icon"], r["line"]) for r in R.symbol_items(symbols).collect()}
    assert got == {("b (function)", "symbol-function", 3), ("B (class)", "symbol-class", 1), ("a (enum)", "symbol-enum", 0), ("c (type)", "symbol-type-parameter", 0)}


def test_tree_orders(spark):
    files = spark.createDataFrame([(0, "b.ts"), (1, "src/x/c.ts"), (2, "a.ts"), (3, "src/d.ts")], "n long, relative_path string")
    tree = T.nodes(files, order="n")
    assert [r["name"] for r in T.children(tree, "").collect()] == ["src", "b.ts", "a.ts"]
    assert [r["name"] for r in T.children(tree, "", folders_first=False).collect()] == ["b.ts", "src", "a.ts"]
    assert [(r["name"], r["n_files"]) for r in T.children(tree, "src").collect()] == [("x", 1), ("d.ts", 1)]


MESSAGES = [
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":10}', True),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":0}', True),
    ('{"type":"navigate","filePath":"/r/p","line":2.0}', True),
    ('{"type":"symbols","filePath":"/r/p/a.ts","line":1}', False),
    ('{"filePath":"/r/p/a.ts","line":1}', False),
    ('{"type":"navigate","line":1}', False),
    ('{"type":"navigate","filePath":"","line":1}', False),
    ('{"type":"navigate","filePath":5,"line":1}', False),
    ('{"type":"navigate","filePath":"p/a.ts","line":1}', False),
    ('{"type":"navigate","filePath":"/r/p/../a.ts","line":1}', False),
    ('{"type":"navigate","filePath":"/r/p/a..b.ts","line":1}', False),
    ('{"type":"navigate","filePath":"/r/px/a.ts","line":1}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts"}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":-1}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":1.5}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":9007199254740992}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":"0"}', False),
    ('{"type":"navigate","filePath":"/r/p/a.ts","line":null}', False),
    ("null", False),
    ('"text"', False),
    ("42", False),
    (None, False),
    ("{not json", False),
]


def test_navigate_messages(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MESSAGES)], "i int, m string")
    got = [r["ok"] for r in df.select("i", V.navigate_message(F.col("m"), F.lit("/r/p")).alias("ok")).orderBy("i").collect()]
    assert got == [ok for _, ok in MESSAGES]
    assert one(spark, V.navigate_message(F.lit(MESSAGES[0][0]), F.lit(""))) is False
    assert one(spark, V.navigate_message(F.lit(MESSAGES[0][0]), F.lit(None).cast("string"))) is False
    line = lambda x: V.may_navigate(F.lit("/r/p/a"), F.lit(float(x)), F.lit("navigate"), F.lit("/r/p"))
    assert [one(spark, line(x)) for x in ("inf", "nan", "3")] == [False, False, True]


def test_view_state(spark):
    rows = [(1, "a", "symbols", 0), (2, "a", "ready", 9), (1, "b", "ready", 1), (1, "c", "symbols", 0), (2, "c", "symbols", 3)]
    df = spark.createDataFrame(rows, "seq long, panel string, type string, n_files long")
    assert {r["panel"]: r["state"] for r in R.view_state(df, "panel").collect()} == {"a": "empty", "b": "loading", "c": "loaded"}


def test_traversals(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(4,)], "node long")
    assert {(r["node"], r["hops"]) for r in G.blast_radius(edges, seeds, 2).collect()} == {(4, 0), (3, 1), (5, 1), (2, 2)}
    assert {(r["node"], r["length"]) for r in G.cycles(edges, 4).collect()} == {(1, 3), (2, 3), (3, 3)}
    nodes = spark.range(1, 6).select(F.col("id").alias("node"))
    assert [r["node"] for r in G.dead_code(nodes, edges).collect()] == [5]
    assert {r["node"] for r in G.core_nodes(edges, 2).collect()} == {4}
    assert G.subgraph(edges, seeds, 1).count() == 2  # (3, 4) and (5, 4)
    assert G.mermaid(edges, 1).splitlines()[1] == '  n_1["1"] --> n_2["2"]'


@pytest.mark.parametrize("glob, path, expected", [("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("*.ts", "src/b.ts", False), ("**/*.test.*", "x/a.test.ts", True), ("a?.ts", "ab.ts", True)])
def test_globs(spark, glob, path, expected):
    assert one(spark, F.lit(path).rlike(G.glob_pattern(glob))) is expected


def test_tree_expansion(spark):
    files, symbols = tables(spark)
    tree = T.nodes(files.where("id <> '4'").withColumn("n", F.col("id").cast("long")), order="n")
    opened = lambda node, kind: [(r["kind"], r["label"]) for r in T.expand(tree, files, symbols, node, kind).orderBy("ord").collect()]
    assert opened("", "dir") == [("dir", "src"), ("file", "r.md")]
    assert opened("src", "dir") == [("file", "z.ts"), ("file", "a.ts")]
    assert opened("src/z.ts", "file") == [("symbol", "B (class)"), ("symbol", "b (function)")]
    assert opened("r.md", "file") == [] and opened("b", "symbol") == []


def test_blast_radius_tells_core_hits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    seeds, core = spark.createDataFrame([(3,)], "node long"), spark.createDataFrame([(1,), (9,)], "node long")
    assert {(r["node"], r["hops"], r["is_core"]) for r in G.blast_radius(edges, seeds, 5, core).collect()} == {(3, 0, False), (2, 1, False), (1, 2, True)}
