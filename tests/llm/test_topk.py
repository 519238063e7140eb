import duckdb
import numpy as np
import pytest

from loomgraph.llm import topk as K


def brute(rows, k=20, stride=20):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.array(v + [0] * (dim - len(v)), dtype=object)) for i, v in usable]
    queries = {}
    for i, v in usable:
        if i % stride == 0:
            queries[i] = min(queries[i], v.astype(np.int64).tobytes()) if i in queries else v.astype(np.int64).tobytes()
    out = []
    for i, blob in queries.items():
        q = np.frombuffer(blob, np.int64).astype(object)
        scored = sorted(((-int((q * v).sum()), j) for j, v in usable if j != i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    assert found(K.op10_top_k(spark, small)) == sorted(con.execute(K.OP10_SQL).fetchall())


@pytest.mark.parametrize("hot", [0, 400])
def test_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(K, "CELL_ROWS", 100)
    monkeypatch.setattr(K, "ANNULUS", 16)
    rng = np.random.default_rng(hot)
    vectors = np.concatenate([rng.normal(size=(800, 6)), np.tile(rng.normal(size=6), (hot, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert found(K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 7)) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 7)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0]), (20, [0.5]), (7, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-3.0, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as pivot", "'y' as score", "'z' as cell")
    assert found(K.top_k(df)) == brute(rows)
    assert K.top_k(df.where("false")).collect() == []
    assert found(K.top_k(df.where("vec_id = 0"))) == []


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_far_below_the_rows(spark, monkeypatch, spread):
    """Clustered and unclustered vectors, 40 pivots and pieces of 25 rows, several groups of queries, small annuli and blocks."""
    for name, value in {"CELL_ROWS": 25, "ANNULUS": 8, "BLOCK": 5, "QUERY_GROUP": 12}.items():
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(0, 12, 1000)] + spread * rng.normal(size=(1000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert found(K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5)) == brute(rows, 5)


def test_annuli_leave_out_what_cannot_win():
    """Of a cell far away no vector is scored; and a block's queries get what each alone gets."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(600, 4)) * 3).astype(np.int64) + np.where(np.arange(600) < 300, 100, -100)[:, None] * np.array([1, 0, 0, 0])
    largest = float((x * x).sum(axis=1).max())
    real = np.column_stack([x, np.sqrt(largest - (x * x).sum(axis=1))])
    pivot = real[0]
    to_pivot = np.sqrt(((real - pivot) ** 2).sum(axis=1))
    queries = x[:40]
    d = np.sqrt(((np.column_stack([queries, np.zeros(40)]) - pivot) ** 2).sum(axis=1))
    cell = K.Cell(np.arange(600), x, to_pivot, largest, float(np.abs(x).max()) ** 2 * 4, 16)
    top = cell.search(np.arange(40), queries, d, np.full(40, K.NOTHING), 7)
    for i in range(40):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(600) if j != i)[:7]
        own = top.query == i
        assert list(zip((-top.got[own]).tolist(), top.ids[own].tolist())) == want
    scored = []
    plain = K.scores
    try:
        K.scores = lambda q, v, r: scored.append(len(v)) or plain(q, v, r)
        best = np.sort(x[:1] @ x.T, axis=1)[:, -2]
        cell.search(np.arange(1), queries[:1], d[:1], best, 7)
    finally:
        K.scores = plain
    assert sum(scored) <= 320  # of its own cluster


def test_scores_beyond_64_bits(spark):
    """Vectors whose scores could wrap take no part; the largest that take part are scored exactly."""
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1e30, 1.0]), (3, [3e9, 3e9]), (4, [1e7, -1e7]), (20, [2.0**24, 2.0**24 - 1]), (21, [-(2.0**24), 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(K.top_k(df))
    assert got == brute([r for r in rows if r[0] not in (2, 3)])
    assert max(abs(r[3]) for r in got) > 2**53


def test_a_piece_goes_where_it_is_visited(spark, monkeypatch):
    """Twelve far clusters, a group of queries for each eight of them: pieces meet few of the groups."""
    for name, value in {"CELL_ROWS": 50, "ANNULUS": 8, "BLOCK": 5, "QUERY_GROUP": 8}.items():
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(3)
    vectors = np.eye(12)[rng.integers(0, 12, 1200)] * 50 + rng.normal(size=(1200, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3)
    assert found(df) == brute(rows, 3)


def test_a_small_table_has_several_pivots(spark, small, monkeypatch):
    seen = []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: seen.append(value) or plain(value))
    K.op10_top_k(spark, small)
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert len(seen[0]) == int(n**0.5) // 2 > 5
