"""Strongly connected components against a plain version."""

import random

from loomgraph.operators import strong as C


def plain(nodes, edges):
    nodes = set(nodes) | {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, rest = {n}, [n]
        while rest:
            for m in to[rest.pop()] - seen:
                seen.add(m)
                rest.append(m)
        reach[n] = seen
    of = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    return {n: (of[n], sum(of[m] == of[n] for m in nodes)) for n in nodes}


def check(spark, nodes, edges):
    tables = spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long")
    got = C.strong_components(*tables, local_edges=0)
    assert sorted(map(tuple, C.strong_components(*tables).collect())) == sorted(map(tuple, got.collect()))
    assert {r["node"]: (r["component"], r["size"]) for r in got.collect()} == plain(nodes, edges)
    return got


def test_random_graphs(spark):
    draw = random.Random(11)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(75)] + [(100 + draw.randrange(9), 100 + draw.randrange(9)) for _ in range(30)] + [(5, 5), (7, 8), (7, 8)]
    check(spark, range(50), edges)


def test_a_long_circle_and_a_chain(spark, monkeypatch):
    """A circle of 200 nodes, a chain of 150 that leads into it, and one of 50 out of it; rounds follow the logarithm of their length."""
    hops = []
    plain_round = C._round
    monkeypatch.setattr(C, "_round", lambda *a: hops.append(1) or plain_round(*a))
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(1150, 17)] + [(33, 2000)] + [(2000 + i, 2001 + i) for i in range(50)]
    got = check(spark, [], edges)
    assert len(hops) < 40
    assert C.circular(got, spark.createDataFrame(edges, "src long, dst long")).count() == 200


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (None,), (1,)], "node long")
    assert [tuple(r) for r in C.strong_components(nodes, none).collect()] == [(1, 1, 1)]
    half = spark.createDataFrame([(1, None), (None, 2)], "src long, dst long")
    assert sorted(tuple(r) for r in C.strong_components(nodes, half).collect()) == [(1, 1, 1), (2, 2, 1)]


def test_chains_are_contracted(spark, monkeypatch):
    """A ladder of circles whose labels would need a round for each meeting place: contraction takes it in few steps, and no round of labels."""
    steps, hops = [], []
    plain_step, plain_round = C._contracted, C._round
    monkeypatch.setattr(C, "_contracted", lambda *a: steps.append(1) or plain_step(*a))
    monkeypatch.setattr(C, "_round", lambda *a: hops.append(1) or plain_round(*a))
    ladder = [(3 * i, 3 * i + 1) for i in range(40)] + [(3 * i + 1, 3 * i + 2) for i in range(40)] + [(3 * i, 3 * i + 2) for i in range(40)] + [(3 * i + 2, 3 * i + 3) for i in range(40)]
    edges = ladder + [(120, 0)] + [(500 + i, 501 + i) for i in range(60)] + [(119, 500), (700, 701), (701, 700), (560, 700)]
    nodes, table = spark.createDataFrame([(9,), (999,)], "node long"), spark.createDataFrame(edges, "src long, dst long")
    got = C.strong_components(nodes, table, local_edges=0)
    assert {r["node"]: (r["component"], r["size"]) for r in got.collect()} == plain([9, 999], edges)
    assert not hops and len(steps) < 25


def test_dense_parts_go_by_labels(spark, monkeypatch):
    """Nodes of three edges each way can't be contracted; a chain, circles and pendants around them are."""
    hops = []
    plain_round = C._round
    monkeypatch.setattr(C, "_round", lambda *a: hops.append(1) or plain_round(*a))
    draw = random.Random(5)
    dense = [(o + a, o + (a * 7 + k * 11 + draw.randrange(2)) % 30) for o in (0, 100, 200) for a in range(30) for k in range(4)]
    edges = dense + [(3, 50), (50, 51), (51, 9), (5, 110), (120, 60), (60, 210), (220, 300), (300, 301), (301, 220), (400, 1)]
    nodes, table = spark.createDataFrame([], "node long"), spark.createDataFrame(edges, "src long, dst long")
    got = C.strong_components(nodes, table, local_edges=0)
    assert {r["node"]: (r["component"], r["size"]) for r in got.collect()} == plain([], edges)
    assert hops
