import numpy as np
import pytest
from brute import components, counted, read, simhash

from loomgraph.llm import neardup as N


def expected(rows):
    """doc_id, fingerprint and component_id of rows, by comparing all pairs."""
    prints = [simhash(r["text"]) for r in rows]
    roots = components(prints)
    least = {}
    for r, root in zip(rows, roots):
        ids = least.setdefault(root, [])
        if r["doc_id"] is not None:
            ids.append(r["doc_id"])
    return [{"doc_id": r["doc_id"], "fingerprint": f"{p:016x}", "component_id": min(least[root], default=None)} for r, p, root in zip(rows, prints, roots)]


def check(spark, folder):
    columns = ("doc_id", "fingerprint", "component_id")
    got = [r.asDict() for r in N.op6_near_dedup(spark, folder).collect()]
    assert counted(expected(read(spark, folder)), *columns) == counted(got, *columns)


def test_query(spark, small):
    check(spark, small)


def test_odd(spark, saved, saved_none, odd, none):
    check(spark, saved)
    assert N.op6_near_dedup(spark, saved_none).collect() == []
    kept = N.keep_first(odd)
    assert kept.columns == odd.columns
    firsts = {r["component_id"] for r in expected([r.asDict() for r in odd.collect()]) if r["component_id"] is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(firsts)
    assert N.keep_first(none).collect() == []


def test_null_and_repeated_ids_lose_no_component(spark):
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in ("ash", "birch", "cedar", "elm", "fir")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (3, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in N.keep_first(docs).collect()), key=lambda r: r[1])
    assert kept == [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[4])]


def clustered(rng, n, groups, flips):
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, groups, dtype=np.uint64)
    out = base[rng.integers(0, groups, n)]
    for i in range(n):
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            out[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(out)


@pytest.mark.parametrize("n, groups, flips", [(700, 300, 4), (1500, 3, 5), (900, 900, 1), (1400, 1, 9)])
def test_tree_join_is_exact(n, groups, flips):
    points = clustered(np.random.default_rng(n), n, groups, flips)
    rng = np.random.default_rng(1)
    tree = N.Tree(rng.permutation(points)[:200], 3, 4)
    home, which, leaf = tree.route(points)
    one = N.Groups(len(points))
    place = {int(p): i for i, p in enumerate(points)}
    for k in range(8):
        u, v = N.shard_links(points[home == k], points[which[leaf == k]], 4)
        one.unite(np.array([place[int(x)] for x in u], dtype=int), np.array([place[int(x)] for x in v], dtype=int))
    assert one.find(np.arange(len(points))).tolist() == components([int(p) for p in points])


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 100), (7, 7)]
    found = N.components(spark.createDataFrame(rows, "u long, v long"))
    got = {r["u"]: r["root"] for r in found.collect()}
    assert {k: got.get(k, k) for k in range(61)} == {k: 0 for k in range(61)}
    assert got[200] == got[300] == 100
    assert N.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_go_on_until_nothing_changes(spark):
    """A shuffled chain of 700 nodes takes many rounds."""
    order = np.random.default_rng(6).permutation(700).tolist()
    found = N.components(spark.createDataFrame(list(zip(order[:-1], order[1:])), "u long, v long"))
    assert {r["u"]: r["root"] for r in found.collect()} == {k: 0 for k in range(1, 700)}


@pytest.mark.parametrize("most_guests", [1 << 22, 40])
def test_shards_of_several_leaves(spark, monkeypatch, most_guests):
    monkeypatch.setattr(N, "SHARD_POINTS", 32)
    monkeypatch.setattr(N, "MOST_GUESTS", most_guests)
    points = clustered(np.random.default_rng(5), 600, 150, 4)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    roots = {r["u"]: r["root"] for r in N.components(N.links(df)).collect()}
    want = components([int(p) for p in points])
    groups = lambda names: sorted(sorted(g) for g in names)
    mine, theirs = {}, {}
    for p, w in zip(points.view(np.int64).tolist(), want):
        mine.setdefault(roots.get(p, p), []).append(p)
        theirs.setdefault(w, []).append(p)
    assert groups(mine.values()) == groups(theirs.values())


def test_trees_find_candidates_of_the_stage(spark, monkeypatch):
    """Near fingerprints alone bring two texts together: no band does here, and the exact check follows."""
    from loomgraph.llm import resemblance as R

    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"x{k}" for k in range(400))]
    plain = R.bands
    monkeypatch.setattr(R, "bands", lambda sets: plain([np.unique(np.append(s, np.uint64(7919) * np.uint64(len(s)))) for s in sets]) + np.array([[len(s) * 31] for s in sets], dtype=np.uint64))
    kept = N.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2]
