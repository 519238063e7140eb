"""The store, the indexer and the streams, end to end on files in a temporary folder."""

import logging

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import schema as S
from loomgraph.operators import upsert as U
from loomgraph.plans.indexer import Indexer
from loomgraph.streaming import ingest


@pytest.fixture()
def workspace(tmp_path):
    root = tmp_path / "w"
    for name, text in {"src/hello.ts": "export function hello() {}\nexport const edition = 2;\n", "src/empty.ts": "// nothing\n", "notes.md": "# notes\n", "node_modules/x/a.ts": "class No {}", "skip.txt": "x"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def test_index_and_read(spark, tmp_path, workspace):
    indexer = Indexer(spark, str(tmp_path / "db"))
    with pytest.raises(RuntimeError):
        indexer.get_all_files()
    told = indexer.index_workspace(str(workspace))
    assert (told.indexed, told.failed, told.summary) == (3, 0, "Indexed 3 files.")
    assert [r["relative_path"] for r in indexer.get_all_files().collect()] == ["notes.md", "src/empty.ts", "src/hello.ts"]
    assert [(r["name"], r["kind"], r["range"]["start_line"], r["fqn"]) for r in indexer.get_symbols("src/hello.ts").collect()] == [("edition", "variable", 1, "src/hello.ts:edition"), ("hello", "function", 0, "src/hello.ts:hello")]
    assert indexer.get_symbols("src/none.ts").collect() == []
    before = indexer.store.read("file").where("relative_path = 'src/hello.ts'").first()["id"]

    (workspace / "src/hello.ts").write_text("export function wave() {}\n")
    result = indexer.index_file(str(workspace / "src/hello.ts"), str(workspace))
    assert (result.relative_path, result.symbol_count, result.message) == ("src/hello.ts", 1, "found: wave (Function)")
    tables = indexer.store.snapshot()
    assert tables["file"].count() == 3 and tables["edge"].count() == 1
    assert [r["name"] for r in tables["symbol"].collect()] == ["wave"]
    assert tables["file"].where("relative_path = 'src/hello.ts'").first()["id"] == before
    assert indexer.index_file(str(workspace / "src/empty.ts"), str(workspace)).message == "found 0 symbols in src/empty.ts."

    (workspace / "src/empty.ts").write_text("class Now {}\n")
    from loomgraph.sources import workspace as W

    assert indexer.index_incremental(W.workspace(spark, str(workspace))).indexed == 1
    indexer.dispose()
    with pytest.raises(RuntimeError):
        indexer.get_all_files()


def test_rollback_and_rules(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"))
    store.initialize()
    assert store.tables() == sorted(S.TABLES)
    row = spark.createDataFrame([("1", "/p", "p", "typescript", 1, "h")], "id string, path string, relative_path string, language string, loc long, hash string")

    def fail(tables):
        raise KeyError("no")

    with pytest.raises(KeyError):
        store.transaction(fail)
    with pytest.raises(U.ConstraintError, match="not unique"):
        store.transaction(lambda tables: {"file": row.unionByName(row)})
    with pytest.raises(U.ConstraintError, match="hash is null"):
        store.transaction(lambda tables: {"file": row.withColumn("hash", F.lit(None).cast("string"))})
    assert store.read("file").count() == 0 and set(store.current().values()) == {0}
    store.transaction(lambda tables: {"file": S.conform(row, "file")})
    got = store.read("file").first()
    assert (got["is_core"], got["tags"], got["metadata"], got["_schema_version"], got["last_author"]) == (False, [], "{}", 1, None)
    store.vacuum()
    assert store.read("file").count() == 1


def test_batches_progress_and_cancelling(spark, tmp_path, workspace):
    seen, told = [], []
    indexer = Indexer(spark, str(tmp_path / "db"), lambda: told.append(1))
    done = indexer.index_workspace(str(workspace), batches=3, progress=lambda *p: seen.append(p))
    assert (done.indexed, done.failed, seen, told) == (3, 0, [(1, 3), (2, 3), (3, 3)], [1])
    assert sorted(indexer.views("v_")) == sorted(f"v_{t}" for t in S.TABLES)
    assert spark.sql("select count(*) as n from v_symbol s join v_edge e on e.target_id = s.id").first()["n"] == 2
    assert indexer.find_file_id(f"{workspace}/notes.md") and indexer.find_file_id("/none") is None
    other = Indexer(spark, str(tmp_path / "db2"))
    assert other.index_workspace(str(workspace), cancelled=lambda: True).summary == "Indexed 0 files."
    (tmp_path / "bare").mkdir()
    assert other.index_workspace(str(tmp_path / "bare")).indexed == 0


def test_a_failing_file_fails_alone(spark, tmp_path):
    indexer = Indexer(spark, str(tmp_path / "db"))
    sources = spark.createDataFrame([("/w/a.ts", "/w", bytearray(b"class A {}")), ("/w/b.md", "/w", None)], "path string, root string, content binary")
    done = indexer.index_sources(sources)
    assert (done.indexed, done.failed, done.summary) == (1, 1, "Indexed 1 files (1 failed).")
    assert [r["relative_path"] for r in indexer.get_all_files().collect()] == ["a.ts"]


def test_one_writer(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"))
    store.initialize()
    with store._locked(), pytest.raises(RuntimeError, match="another writer"):
        store.transaction(lambda tables: {})
    store.transaction(lambda tables: {})


def test_last_content_under_first_id(spark):
    log = spark.createDataFrame([("a", 1, "x", "i1"), ("a", 2, "y", "i2"), ("b", 3, "z", "i3")], "path string, seq long, hash string, id string")
    stored = spark.createDataFrame([("old", "b")], "id string, path string")
    got = {r["path"]: (r["id"], r["hash"]) for r in U.latest_per_path(log, stored).collect()}
    assert got == {"a": ("i1", "y"), "b": ("old", "z")}


def test_edges_of_old_symbols_go(spark):
    edges = spark.createDataFrame([("e1", "f1", "s1"), ("e2", "s1", "s9"), ("e3", "f2", "s2")], "id string, source_id string, target_id string")
    replaced, old = spark.createDataFrame([("f1",)], "id string"), spark.createDataFrame([("s1",)], "id string")
    assert {r["id"] for r in U.keep_edges(edges, replaced, old).collect()} == {"e2", "e3"}


def test_file_stream(spark, tmp_path, workspace):
    indexer = Indexer(spark, str(tmp_path / "db"))
    pushed = str(tmp_path / "pushed")
    for expected in (2, 1):
        ingest.index_stream(indexer, ingest.file_stream(spark, str(workspace)), str(tmp_path / "cp"), ingest.push_json(pushed)).awaitTermination(120)
        assert indexer.store.read("symbol").count() == expected or expected == 1
        (workspace / "src/more.ts").write_text("enum More { A }\n")
    assert {r["name"] for r in indexer.store.read("symbol").collect()} == {"hello", "edition", "More"}
    assert spark.read.json(pushed).where("type = 'symbols'").count() == 4


def test_view_stream(spark, tmp_path):
    folder = str(tmp_path / "messages")
    spark.createDataFrame([(1, "a", "symbols", 0, ""), (2, "a", "symbols", 2, ""), (1, "b", "ready", 0, "")], ingest.MESSAGES).write.json(folder)
    stream = spark.readStream.schema(ingest.MESSAGES).json(folder)
    query = ingest.view_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["panel"]: r["state"] for r in spark.table("states").collect()} == {"a": "loaded", "b": "loading"}


def test_excluded_folders_are_never_opened(spark, tmp_path, workspace):
    from loomgraph.sources import workspace as W

    (workspace / "node_modules/x/big.ts").write_text("x" * 5000)
    (workspace / "src/a[1] {2}*.ts").write_text("enum Odd { A }")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # opening the large file would fail
    try:
        got = {r["path"]: bytes(r["content"]) for r in W.workspace(spark, str(workspace)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(p.removeprefix(f"{workspace}/") for p in got) == ["notes.md", "src/a[1] {2}*.ts", "src/empty.ts", "src/hello.ts"]
    assert got[f"{workspace}/src/a[1] {{2}}*.ts"] == b"enum Odd { A }"
    (tmp_path / "bare").mkdir()
    assert W.workspace(spark, str(tmp_path / "bare")).collect() == []


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"), buckets=8)
    store.initialize()
    from loomgraph.operators.extract import extract_files

    files = lambda names, text: extract_files(spark.createDataFrame([(f"/w/{n}.ts", "/w", bytearray(text.encode())) for n in names], "path string, root string, content binary"))
    names = [f"f{i}" for i in range(40)]
    store.replace_files(files(names, "class A {}\nclass B {}"))
    before = store.layout()
    assert sum(v == 1 for v in before["file"]) == sum(v == 1 for v in before["symbol"]) > 4
    # a call from another file's symbol into the file that comes next: its bucket is written as well
    ids = {r["relative_path"]: r["id"] for r in store.read("file").collect()}
    targets = [r["id"] for r in store.of_file("symbol", ids["f7.ts"]).collect()]
    call = spark.createDataFrame([("call-1", "some-symbol", targets[0], "call"), ("call-2", "some-symbol", "elsewhere", "call")], "id string, source_id string, target_id string, kind string")
    store.transaction(lambda t: {"edge": t["edge"].unionByName(S.conform(call, "edge"))})
    before = store.layout()
    store.replace_files(files(["f7"], "enum C { X }"))
    after = store.layout()
    changed = {name: [b for b in range(8) if before[name][b] != after[name][b]] for name in before}
    assert len(changed["file"]) == 1 and changed["symbol"] == changed["file"] and 1 <= len(changed["edge"]) <= 2
    assert store.read("file").count() == 40 and store.read("symbol").count() == 79 and store.read("edge").where("kind = 'structural'").count() == 79
    assert [r["id"] for r in store.read("edge").where("kind = 'call'").collect()] == ["call-2"]
    assert [(r["name"], r["kind"]) for r in store.of_file("symbol", ids["f7.ts"]).collect()] == [("C", "enum")]
    assert store.of_file("edge", ids["f7.ts"]).count() == 1
    store.vacuum()
    assert store.read("symbol").count() == 79
    store.replace_files(files([], ""))
    assert store.layout() == after


def test_a_lock_names_its_owner_and_grows_stale(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"))
    store.initialize()
    with store._locked(), pytest.raises(RuntimeError, match=spark.sparkContext.applicationId):
        store.transaction(lambda tables: {})
    import os

    lock = tmp_path / "db/_LOCK"
    lock.write_text("a crashed writer")
    os.utime(lock, (1, 1))
    store.transaction(lambda tables: {})
    assert not lock.exists()


def test_in_memory(spark, workspace):
    indexer = Indexer(spark)
    assert indexer.index_workspace(str(workspace)).indexed == 3
    assert {r["name"] for r in indexer.get_symbols("src/hello.ts").collect()} == {"hello", "edition"}


def test_the_last_content_of_a_path_counts(spark, tmp_path):
    rows = [("/w/a.ts", "/w", bytearray(b"class Old {}"), 1), ("/w/a.ts", "/w", bytearray(b"class New {}"), 2)]
    indexer = Indexer(spark, str(tmp_path / "db"))
    indexer.index_sources(spark.createDataFrame(rows, "path string, root string, content binary, seq long"))
    assert [r["name"] for r in indexer.get_symbols("a.ts").collect()] == ["New"]


def test_a_run_is_timed_and_logged(spark, tmp_path, workspace, caplog):
    indexer = Indexer(spark, str(tmp_path / "db"))
    with caplog.at_level(logging.DEBUG, "loomgraph"):
        result = indexer.index_file(str(workspace / "src/hello.ts"), str(workspace))
        bad = spark.createDataFrame([("/w/b.md", "/w", None)], "path string, root string, content binary")
        told = indexer.index_sources(bad)
    assert result.elapsed_ms > 0 and told.elapsed_ms > 0 and told.failed == 1
    assert "indexed src/hello.ts: 2 symbols" in caplog.text and "failed to index /w/b.md: no content" in caplog.text


FOUND = "array<struct<name: string, kind: string, start_line: long, start_col: long, end_line: long, end_col: long>>"
INCOMING = f"path string, relative_path string, language string, loc long, hash string, found {FOUND}, seq long"


def incoming(spark, *names, symbols=1):
    rows = [(f"/w/{n}", n, "typescript", 1, "h", [(f"s{k}", "class", k, 0, k, 1) for k in range(symbols)], 0) for n in names]
    return spark.createDataFrame(rows, INCOMING)


def test_vanished_files_leave_the_graph(spark, tmp_path, workspace):
    from loomgraph.sources import workspace as W

    indexer = Indexer(spark, str(tmp_path / "db"))
    indexer.index_workspace(str(workspace))
    other = tmp_path / "other"
    other.mkdir()
    (other / "far.ts").write_text("class Far {}\n")
    indexer.index_workspace(str(other))
    now = indexer.store.snapshot()
    hello = now["file"].where("relative_path = 'src/hello.ts'").first()["id"]
    empty = now["file"].where("relative_path = 'src/empty.ts'").first()["id"]
    far = now["symbol"].where("name = 'Far'").first()["id"]
    wave = now["symbol"].where("name = 'hello'").first()["id"]
    # edges from and to what will vanish, and what a later pass found in it
    edges = spark.createDataFrame([("e1", empty, wave, "call"), ("e2", wave, far, "call"), ("e3", empty, hello, "import"), ("e4", empty, far, "call")], "id string, source_id string, target_id string, kind string")
    sites = spark.createDataFrame([("c1", hello), ("c2", empty), ("c3", None)], "id string, file_id string")
    indexer.store.transaction(lambda t: {"edge": t["edge"].unionByName(S.conform(edges, "edge")), "call_site": S.conform(sites, "call_site"), "diagnostic": S.conform(sites, "diagnostic")})

    (workspace / "src/hello.ts").unlink()
    (workspace / "notes.md").write_text("# other\n")
    assert indexer.index_incremental(W.workspace(spark, str(workspace))).removed == 0
    assert indexer.store.read("file").count() == 4
    told = indexer.index_workspace_incremental(str(workspace), batches=2)
    assert (told.indexed, told.removed) == (0, 1)
    now = indexer.store.snapshot()
    assert sorted(r["relative_path"] for r in now["file"].collect()) == ["far.ts", "notes.md", "src/empty.ts"]
    assert [r["name"] for r in now["symbol"].collect()] == ["Far"]
    assert sorted(r["id"] for r in now["edge"].where("kind <> 'structural'").collect()) == ["e4"]
    assert now["edge"].where("kind = 'structural'").count() == 1
    for name in ("call_site", "diagnostic"):
        assert sorted(r["id"] for r in now[name].collect()) == ["c2", "c3"]
    for path in [*workspace.rglob("*.ts"), workspace / "notes.md"]:
        path.unlink()
    assert indexer.index_workspace_incremental(str(workspace)).removed == 2
    assert [r["relative_path"] for r in indexer.get_all_files().collect()] == ["far.ts"]


def test_a_living_writer_keeps_its_lock(spark, tmp_path):
    """A writer that takes longer than a lock may be old renews it; another one is refused meanwhile."""
    import time

    store, other = (U.Store(spark, str(tmp_path / "db"), stale_seconds=2) for _ in range(2))
    store.initialize()
    told = []

    def slow(tables):
        time.sleep(5)
        with pytest.raises(RuntimeError, match="another writer"):
            other.replace_files(incoming(spark, "b.ts"))
        told.append(True)
        return {"file": tables["file"]}

    store.transaction(slow)
    assert told
    other.replace_files(incoming(spark, "b.ts"))
    assert other.read("file").count() == 1


def test_a_lock_that_was_taken_over_commits_nothing(spark, tmp_path):
    store, other = (U.Store(spark, str(tmp_path / "db")) for _ in range(2))
    store.initialize()

    def robbed(tables):
        other._fs.delete(other._path(f"{other.path}/_LOCK"), False)  # as if it had been found stale
        other.replace_files(incoming(spark, "b.ts"))
        return {"file": tables["file"]}

    with pytest.raises(RuntimeError, match="taken over"):
        store.transaction(robbed)
    assert [r["relative_path"] for r in store.read("file").collect()] == ["b.ts"]
    with other._locked():
        with pytest.raises(RuntimeError):
            store.replace_files(incoming(spark, "c.ts"))
    store.replace_files(incoming(spark, "c.ts"))
    assert store.read("file").count() == 2


def test_paths_are_unique_across_buckets(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"))
    store.initialize()
    store.replace_files(incoming(spark, "a.ts"))
    held = store.read("file").first()["id"]
    of = lambda i: spark.range(1).select(U.bucket_of(F.lit(i), 16)).first()[0]
    other = next(f"x{k}" for k in range(100) if of(f"x{k}") != of(held))
    row = spark.createDataFrame([(other, "/w/a.ts", "a.ts", "typescript", 1, "h")], "id string, path string, relative_path string, language string, loc long, hash string")
    with pytest.raises(U.ConstraintError, match="path is not unique"):
        store.transaction(lambda t: {"file": S.conform(row, "file")}, {"file": [of(other)]})
    assert store.read("file").count() == 1


def test_buckets_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "BUCKET_FILES", 3)
    store = U.Store(spark, str(tmp_path / "db"), buckets=2)
    store.initialize()
    store.replace_files(incoming(spark, *[f"f{i}.ts" for i in range(9)], symbols=2))
    store.replace_files(incoming(spark, "f1.ts", "f9.ts", symbols=3))
    now = store.snapshot()
    assert {len(v) for v in store.layout().values()} == {8}
    assert (now["file"].count(), now["symbol"].count(), now["edge"].count()) == (10, 22, 22)
    assert store.of_file("symbol", now["file"].where("relative_path = 'f9.ts'").first()["id"]).count() == 3
    store.vacuum()
    store.rebuild(3)
    assert {len(v) for v in store.layout().values()} == {3} and store.read("symbol").count() == 22


def test_little_disk_beside_the_rows(spark, tmp_path):
    """Bloom filters are as large as their rows need, and no shuffle file outlives its write."""
    import os

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for d in local.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_")}
    store = U.Store(spark, str(tmp_path / "db"), buckets=2)
    store.initialize()
    before = shuffles()
    store.replace_files(incoming(spark, *[f"f{i}.ts" for i in range(50)], symbols=3))
    assert not shuffles() - before
    size = sum(f.stat().st_size for f in (tmp_path / "db").rglob("*.parquet"))
    assert size < 1 << 19
    assert store.read("symbol").count() == store.read("edge").count() == 150


def test_whole_tables_are_written_one_after_another(spark, tmp_path, monkeypatch):
    import threading
    import time

    store = U.Store(spark, str(tmp_path / "db"), buckets=2)
    store.initialize()
    at_work, most, lock, plain = [0], [0], threading.Lock(), S.violations

    def watched(df, name):
        with lock:
            at_work[0] += 1
            most[0] = max(most[0], at_work[0])
        time.sleep(0.5)
        with lock:
            at_work[0] -= 1
        return plain(df, name)

    monkeypatch.setattr(S, "violations", watched)
    store.transaction(lambda now: now)
    assert most[0] == 1


def whole(store):
    """All rows of a store but for the times of indexing."""
    return {name: sorted(map(str, df.drop("last_indexed").collect())) for name, df in store.snapshot().items()}


def filled(spark, path):
    """A store with edges and diagnostics across its files; and a batch, with paths to remove."""
    store = U.Store(spark, path, buckets=8)
    store.initialize()
    store.replace_files(incoming(spark, *[f"f{i}.ts" for i in range(40)], symbols=2))
    ids = {r["relative_path"]: r["id"] for r in store.read("file").collect()}
    symbols = {r["fqn"]: r["id"] for r in store.read("symbol").collect()}
    ends = [(symbols[f"f{i}.ts:s0"], symbols[f"f{(i * 7 + 3) % 40}.ts:s1"]) for i in range(40)] + [(ids[f"f{i}.ts"], ids[f"f{(i * 3 + 1) % 40}.ts"]) for i in range(40)]
    edges = spark.createDataFrame([(f"call-{i}", a, b, "call") for i, (a, b) in enumerate(ends)], "id string, source_id string, target_id string, kind string")
    found = spark.createDataFrame([(f"d-{n}", i) for n, i in ids.items()] + [("d-none", None)], "id string, file_id string")
    rows = {"edge": edges, "diagnostic": found}
    gone = spark.createDataFrame([(f"/w/f{i}.ts",) for i in range(0, 40, 5)] + [("/w/f1.ts",), ("/w/none.ts",)], "path string")
    return store, rows, incoming(spark, *[f"f{i}.ts" for i in (*range(1, 50, 4), 48)], symbols=3), gone


def test_a_piecewise_batch_gives_what_one_transaction_does(spark, tmp_path, monkeypatch):
    one, rows, batch, gone = filled(spark, str(tmp_path / "one"))
    one.transaction(lambda t: {name: t[name].unionByName(S.conform(df, name)) for name, df in rows.items()})
    before = one.snapshot()
    latest = U.latest_per_path(batch, before["file"]).localCheckpoint()
    left = before["file"].join(gone, "path", "left_semi").join(latest.select("path"), "path", "left_anti").select("id").localCheckpoint()
    plain = {name: sorted(map(str, df.drop("last_indexed").collect())) for name, df in U.replaced_graph(before, latest, gone=left).items()}
    one.replace_files(batch, gone)
    assert {name: rows for name, rows in whole(one).items() if name in plain} == plain

    pieces, commits = filled(spark, str(tmp_path / "pieces"))[0], []
    monkeypatch.setattr(U, "PIECE_BYTES", 1)
    monkeypatch.setattr(U, "PIECE_FILES", 6)
    commit = U.Store._commit
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "pieces").rglob("*.parquet"))

    def watched(self, *args, **kwargs):
        commit(self, *args, **kwargs)
        commits.append(size())

    monkeypatch.setattr(U.Store, "_commit", watched)
    pieces.add(rows, piecewise=True)
    assert len(commits) > 4
    pieces.vacuum()
    held = size()
    commits.clear()
    pieces.replace_files(batch, gone, piecewise=True)
    assert whole(pieces) == whole(one)
    assert len(commits) > 8 and max(commits) < 1.5 * held


def test_a_piecewise_batch_that_ends_early_leaves_no_edge_to_what_is_gone(spark, tmp_path, monkeypatch):
    store, rows, batch, gone = filled(spark, str(tmp_path / "db"))
    store.add(rows)
    before = whole(store)
    assert len(before["edge"]) == 160 and len(before["diagnostic"]) == 41
    monkeypatch.setattr(U, "PIECE_BYTES", 1)
    commit, left = U.Store._commit, [11]

    def failing(self, *args, **kwargs):
        left[0] -= 1
        if not left[0]:
            raise KeyError("crash")
        commit(self, *args, **kwargs)

    monkeypatch.setattr(U.Store, "_commit", failing)
    with pytest.raises(KeyError):
        store.replace_files(batch, gone, piecewise=True)
    now = store.snapshot()
    there = now["symbol"].select("id").unionByName(now["file"].select("id")).select(F.col("id").alias("target_id"))
    assert now["edge"].join(there, "target_id", "left_anti").count() == 0
    files = {r["id"] for r in now["file"].collect()}
    assert {r["file_id"] for r in now["symbol"].collect()} <= files and len(files) < 48
    left[0] = 1000
    store.replace_files(batch, gone, piecewise=True)  # again, to its end
    assert store.read("file").count() == 40 - 6 + 4 and store.read("symbol").count() == 3 * 14 + 2 * (38 - 14)  # two of those to remove are replaced


def test_ids_of_symbols_and_edges_have_128_bits(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "db"), buckets=2)
    store.initialize()
    store.replace_files(incoming(spark, *[f"f{i}.ts" for i in range(2000)], symbols=5))
    for name in ("symbol", "edge"):
        assert {len(r["id"]) for r in store.read(name).select("id").collect()} == {32}
        size = sum(f.stat().st_size for f in (tmp_path / "db" / name).rglob("*.parquet"))
        assert size < 60 * 10_000, (name, size)


def test_many_ids_are_not_broadcast(spark):
    """A batch of many files takes few bytes as it is written, so that Spark would take its ids through the driver."""
    place = F.struct(F.lit("f").alias("name"), F.lit("function").alias("kind"), *[F.lit(0).cast("long").alias(n) for n in S.RANGE_FIELDS])
    batch = lambda n: spark.range(n).select(F.concat(F.lit("file-"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("/w/f"), F.col("id").cast("string")).alias("path"), F.lit("f").alias("relative_path"), F.lit("typescript").alias("language"), F.lit(1).alias("loc"), F.lit("h").alias("hash"), F.array(place).alias("found"), F.lit(0).cast("long").alias("seq"))
    tables = {"file": S.conform(batch(3).drop("found"), "file").cache(), "symbol": S.empty(spark, "symbol"), "edge": S.empty(spark, "edge")}
    for n in (2, U.FEW_IDS + 1):
        kept = U.kept_graph(tables, U.cut(batch(n), "many"))["file"]
        assert ("BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()) == (n == 2)
        assert kept.count() == max(0, 3 - n)
