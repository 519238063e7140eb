"""Search by small-world graphs against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import vectorgraph as A

SCHEMA = "vec_id long, embedding array<float>, note string"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in row], "x") for i, row in enumerate(x)], SCHEMA)


def clustered(n, seed, centres=40, d=16):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, d))


def nearest(x, q, most):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.argsort(-(unit(q) @ unit(x).T), axis=1, kind="stable")[:, :most]


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_and_work_of_a_shard(kind):
    x = np.random.default_rng(3).normal(size=(6000, 64)) if kind == "random" else clustered(6000, 3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    places, score, scored = A.walk(x, A.links(x), x[::50], 10)
    true = nearest(x, x[::50], 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(places, true)]) >= 0.9
    assert scored.mean() < 0.5 * len(x)
    assert (np.diff(score, axis=1) <= 0).all()


def test_shards_are_merged(spark):
    x = clustered(3000, 5)
    vectors = table(spark, x)
    graph = A.build(vectors, 16, shard_rows=1000)
    assert graph.select("shard").distinct().count() == 3 and graph.select(F.explode("ids")).count() == 3000
    got = A.search(graph, vectors.where("vec_id % 100 = 0"), 16, most=10).collect()
    true = nearest(x, x[::100], 10)
    found = {}
    for r in got:
        found.setdefault(r["query_id"] // 100, {})[r["rank"]] = r["id"]
        assert r["scored"] < 3000
    assert all(sorted(ranks) == list(range(1, 11)) for ranks in found.values()) and len(found) == 30
    assert np.mean([len(set(found[i].values()) & set(true[i])) / 10 for i in range(30)]) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (2, [1.0, 0.0], "b"), (None, [0.0, 2.0], "c"), (3, None, "d"), (4, [1.0], "e"), (5, [0.0, 0.0], "f"), (6, [float("nan"), 1.0], "g"), (7, [float("inf"), 1.0], "h"), (8, [None, 1.0], "i"), (9, [1e-30, 1e-30], "j")]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("id", F.lit("clash"))
    graph = A.build(vectors, 2)
    assert graph.count() == 3 and graph.select(F.explode("ids")).count() == 5
    got = [(r["query_id"], r["rank"], r["id"], round(r["cosine"], 6)) for r in A.search(graph, vectors.where("vec_id in (1, 3, 5, 9)"), 2, most=9).orderBy("query_id", "rank").collect()]
    half = round(0.5**0.5, 6)
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 2, 1.0), (1, 4, 9, half), (1, 5, None, 0.0), (9, 1, 9, 1.0), (9, 2, 1, half), (9, 3, 2, half), (9, 4, 2, half), (9, 5, None, half)]
    none = A.build(vectors.where("false"), 2)
    assert none.count() == 0 and A.search(none, vectors, 2).collect() == []
    assert A.search(graph, vectors.where("false"), 2).collect() == []
    assert A.search(A.build(vectors.where("vec_id = 1"), 2), vectors.where("vec_id = 9"), 2).count() == 1


def test_large_keys_beside_a_null(spark):
    keys = [2**53 + 1, 2**53 + 3, None, -5]
    graph = A.build(spark.createDataFrame([(k, [1.0, 1.0], "") for k in keys], SCHEMA), 2)
    got = A.search(graph, spark.createDataFrame([(2**60 + 1, [2.0, 2.0], ""), (None, [1.0, 1.0], "")], SCHEMA), 2, most=4).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(2**60 + 1, k) for k in (-5, 2**53 + 1, 2**53 + 3, None)]


def test_copies_do_not_hide_others(spark):
    x = np.vstack([np.tile([1.0, 0.0, 0.0], (400, 1)), clustered(600, 9, d=3)])
    vectors = table(spark, x)
    got = A.search(A.build(vectors, 3, shard_rows=500), table(spark, [[0.9, 0.1, 0.0]], first=10_000), 3, most=5).orderBy("rank").collect()
    true = nearest(x, np.array([[0.9, 0.1, 0.0]]), 5)[0]
    assert [r["id"] for r in got] == [int(i) for i in true]
    # many copies beside the best rows, and as the best rows
    q = table(spark, [[1.0, 0.0, 0.0]], first=10_000)
    assert [r["id"] for r in A.search(A.build(vectors, 3, shard_rows=500), q, 3, most=5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_exact_search_misses_none(spark):
    """Random directions, narrow walks and shards: with exact, all distances' own answer."""
    x = np.random.default_rng(8).normal(size=(4000, 32))
    vectors = table(spark, x)
    graph = A.build(vectors, 32, shard_rows=1500)
    asked = vectors.where("vec_id % 40 = 0")
    true = {i * 40: row.tolist() for i, row in enumerate(nearest(x.astype(np.float32), x[::40].astype(np.float32), 10))}
    answers = {}
    for exact in (False, True):
        found = {}
        for r in A.search(graph, asked, 32, most=10, beam=10, exact=exact).orderBy("rank").collect():
            found.setdefault(r["query_id"], []).append(r["id"])
        answers[exact] = found
    assert answers[False] != true and answers[True] == true
