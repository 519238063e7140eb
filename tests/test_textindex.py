"""The stored symbol index against scans, and what lookups read."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import schema as S
from loomgraph.operators import textindex as N
from loomgraph.operators import upsert as U

FOUND = "array<struct<name: string, kind: string, start_line: long, start_col: long, end_line: long, end_col: long>>"
WORDS = ["read", "write", "file", "Parser", "HTTP", "server", "index_of", "token", "tree", "walk"]


def batch(spark, numbers, shift=0):
    rows = []
    for i in numbers:
        names = [WORDS[(i + k + shift) % 10] + WORDS[(i * 3 + k) % 10].capitalize() for k in range(i % 5)] + ["", "readRead"] * (i % 7 == 0)
        rows.append((f"/w/f{i}.ts", f"f{i}.ts", "typescript", 1, f"h{shift}", [(n, "function", k, 0, k, 1) for k, n in enumerate(names)], 0))
    return spark.createDataFrame(rows, f"path string, relative_path string, language string, loc long, hash string, found {FOUND}, seq long")


def same(index, words):
    scanned = N.scan_search(index.store.read("symbol"), words).collect()
    assert index.search(words).collect() == scanned
    return scanned


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    store = U.Store(spark, str(tmp_path_factory.mktemp("db")), buckets=4)
    store.initialize()
    return N.SymbolIndex(store)


def test_batches(spark, index, monkeypatch):
    assert index.search("read").collect() == []
    assert index.refresh() and not index.refresh()
    index.store.replace_files(batch(spark, range(40)))
    index.refresh()
    assert len(same(index, "read file")) > 3
    first = index.state()
    index.store.replace_files(batch(spark, [3, 4, 50], shift=1))
    index.refresh()
    same(index, "read file")
    same(index, "http_server walk")
    assert index.state()["segments"] == [*first["segments"], first["segments"][-1] + 1]
    # the last segment holds the postings of the three files alone
    last = spark.read.parquet(f"{index.path}/postings/s={index.state()['segments'][-1]}")
    touched = {r[0] for r in index.store.read("file").where("hash = 'h1'").select("id").collect()}
    assert {r[0] for r in last.select("file_id").distinct().collect()} <= touched
    index.store.replace_files(batch(spark, []), spark.createDataFrame([("/w/f7.ts",), ("/w/f8.ts",)], "path string"))
    index.refresh()
    assert all(r["file_id"] for r in same(index, "read"))
    monkeypatch.setattr(N, "MOST_SEGMENTS", 2)
    index.store.replace_files(batch(spark, [9], shift=2))
    index.refresh()
    assert len(index.state()["segments"]) == 1
    same(index, "read file")
    index.vacuum()
    same(index, "tree parser index")
    index.store.rebuild(6)
    index.refresh()
    same(index, "tree parser index")
    assert index.search("nowhere").collect() == [] and index.search("").collect() == []


def test_a_search_reads_its_words_buckets(spark, index):
    found = index.search("walk")
    read = {f for f in found.inputFiles() if "/postings/" in f}
    own = spark.range(1).select(U.bucket_of(F.lit("walk"), N.BUCKETS)).first()[0]
    assert read and all(f"/b={own}/" in f for f in read)
    assert "IsNotNull(token)" in found._jdf.queryExecution().toString() or re.search(r"EqualTo\(token|In\(token", found._jdf.queryExecution().toString())
    assert not any("/symbol/" in f for f in found.inputFiles())


def test_misspelt(spark, index):
    assert index.suggest("parsr") == ["parser"]
    assert index.suggest("zzzzzz") == []
    want = [r["id"] for r in index.search("parser tree").collect()]
    assert [r["id"] for r in index.search_misspelt("parsr tree").collect()] == want
    assert index.search_misspelt("qqqqqq").collect() == []


def rows_read(df):
    """Rows that the plan's scans gave."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    total, rest = 0, [text]
    while rest:
        node = rest.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            rest.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        rest += [children.apply(i) for i in range(children.size())]
    return total


def test_lookups_skip(spark, tmp_path):
    """By target, by path and by qualified name: Bloom filters leave most of the buckets unread."""
    store = U.Store(spark, str(tmp_path / "db"), buckets=8)
    store.initialize()
    edges = spark.range(80000).select(F.concat(F.lit("e"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("source_id"), F.sha2((F.col("id") * 7 % 60000 + 100000).cast("string"), 256).alias("target_id"), F.lit("call").alias("kind"))
    store.transaction(lambda now: {"edge": S.conform(edges, "edge")})
    target = edges.where("id = 'e500'").first()["target_id"]
    want = sorted(r["id"] for r in edges.where(F.col("target_id") == target).collect())
    assert sorted(r["id"] for r in store.edges_to(target).collect()) == want
    assert 0 < rows_read(store.edges_to(target)) <= 40000
    assert rows_read(store.edges_to("f" * 64)) <= 20000
    assert rows_read(store.read("edge")) == 80000


def test_a_refresh_hands_on_files_and_spreads_a_common_word(spark, tmp_path):
    """Symbols that `deal` put together are written where they are; files are compared by a row each; a word that all names share has several tasks."""
    store = U.Store(spark, str(tmp_path / "db"), buckets=4)
    store.initialize()
    rows = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("f"), (F.col("id") % 500).cast("string")).alias("file_id"), F.concat(F.lit("read_read_n"), F.col("id") % 7, F.when(F.col("id") % 2 == 0, "_read").otherwise("")).alias("name"), (F.col("id") % 500).alias("key"))
    rows = rows.withColumns({"fqn": F.col("name"), "kind": F.lit("function"), "range": F.struct(*[F.lit(0).cast("long").alias(n) for n in S.RANGE_FIELDS]), "language": F.lit("typescript")})
    dealt = store.deal(rows, "symbol")
    index = N.SymbolIndex(store)
    for part, n in (("key % 2 = 0", 1500), ("true", 3000), ("key % 5 <> 0", 2400)):
        store.transaction(lambda now: {"symbol": S.empty(spark, "symbol")}, dealt={"symbol": dealt.where(part)})
        assert store.read("symbol").count() == n and store.read("symbol").select("id").exceptAll(rows.where(part).select("id")).isEmpty()
        assert index.refresh() and index.state()["symbols"] == n
        same(index, "read n3")
    listed = [spark.read.parquet(f"{index.path}/files/s={s}").count() for s in index.state()["segments"]]
    assert listed == [250, 250, 100]
    assert spark.read.parquet(f"{index.path}/postings/s=1").where("token = 'read'").select(F.input_file_name()).distinct().count() > 1
    assert {tuple(r) for r in spark.read.parquet(f"{index.path}/postings/s=1").where("token = 'read'").select("times", "length").distinct().collect()} == {(3, 4)}
    plan = N._changed(rows, rows.where("false"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(file_id#\d+, \d+\)", plan) and not re.search(r"hashpartitioning\(file_id#\d+, \w+#", plan)
