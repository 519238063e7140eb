import collections

import numpy as np
import pytest
from brute import WORD, counted, read
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import mixing as M


def plain_targets(sizes, weights, total):
    goal, open_ = {}, set(range(len(sizes)))
    while open_:
        left = total - sum(goal.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            goal |= share
            break
        for i in over:
            goal[i] = 3.0 * sizes[i]
            open_.remove(i)
    return [goal[i] for i in range(len(sizes))]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = M.targets(np.array(sizes), np.array(weights, float), float(sum(sizes)))
    assert got == pytest.approx(plain_targets(sizes, weights, sum(sizes)))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 60), st.integers(1, 20))
def test_apportion_by_highest_quotients(votes, seats, most):
    expected = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] and expected[i] < most]
        if not open_:
            break
        expected[max(open_, key=lambda i: (votes[i] / (2 * expected[i] + 1), -i))] += 1
    got = M.apportion(np.array(votes), seats, np.full(len(votes), most)).tolist()
    assert sum(got) == sum(expected)
    # equal quotients may be dealt in another order
    assert sorted(v / (2 * g + 1) for v, g in zip(votes, got)) == pytest.approx(sorted(v / (2 * e + 1) for v, e in zip(votes, expected)))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=12), st.integers(1, 20), st.data())
def test_take(sizes, blocks, data):
    total = sum(sizes)
    blocks = min(blocks, total) if total else 0
    quota = data.draw(st.integers(0, 3 * blocks))
    got = M.take(np.array(sizes), blocks, quota, 5)
    assert all(0 <= g <= 3 * s for g, s in zip(got, sizes))
    if blocks:
        assert abs(got.sum() - quota * total / blocks) <= blocks


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=10), st.integers(1, 15), st.integers(0, 40), st.integers(0, 5))
def test_take_word_by_word(sizes, blocks, quota, seed):
    """The words of whole rounds and of the seeded blocks, counted one at a time."""
    total = sum(sizes)
    blocks = max(1, min(blocks, total))
    rounds, rest = divmod(quota, blocks)
    chosen = set(np.random.default_rng(seed).permutation(blocks)[:rest].tolist())
    edges = [k * total // blocks for k in range(blocks + 1)]
    want, word = [], 0
    for size in sizes:
        inside = 0
        for w in range(word, word + size):
            inside += next(k for k in range(blocks) if edges[k] <= w < edges[k + 1]) in chosen
        want.append(rounds * size + inside)
        word += size
    assert M.take(np.array(sizes), blocks, quota, seed).tolist() == want


def test_a_tiny_source_leaves_the_others_blocks_alone(spark):
    rows = [(i, "w " * 40, "big") for i in range(200)] + [(1000 + i, "x", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in M.mix(docs, (1,)).collect()}
    for own in (range(200), range(1000, 1003)):
        assert abs(sum(got[i]["taken"] for i in own) - got[own[0]]["target"]) <= M.BLOCK_WORDS
    assert got[1000]["target"] == 9.0


def check(spark, folder):
    docs, got = read(spark, folder), [r.asDict() for r in M.op1_mixing(spark, folder).collect()]
    size = lambda r: len(WORD.findall(r["text"] or ""))
    assert counted([r | {"size": size(r)} for r in docs], "doc_id", "size") == counted(got, "doc_id", "size")
    sizes = collections.Counter()
    for r in docs:
        sizes[r["source"]] += size(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, plain_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(sizes.values()))))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(40, 0.02 * goal[s])
    again = [r.asDict() for r in M.op1_mixing(spark, folder).collect()]
    assert counted(got, "doc_id", "source", "size", "taken") == counted(again, "doc_id", "source", "size", "taken")


def test_query(spark, small):
    check(spark, small)


def test_odd(spark, saved, saved_none, odd):
    check(spark, saved)
    assert M.op1_mixing(spark, saved_none).collect() == []
    assert M.resample(odd).columns == odd.columns


def test_hot_source(spark, tmp_path):
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))


@pytest.mark.parametrize("seed", [20240611, 7, 8])
def test_resample_by_rows(spark, seed):
    """A third of the ids null, some ids repeated with other texts, and a row that is there 600 times: every source's words come near its target."""
    rows = [(None if i % 3 == 0 else i // 2, f"t{i} " * (i % 17 + 4), f"s{i % 4}", i) for i in range(2400)] + [(9999, "same " * 10, "s1", -1)] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    got = [r.asDict() for r in M.resample(docs, seed=seed).collect()]
    size = lambda text: len(WORD.findall(text))
    sizes, taken, null_taken, null_size = (collections.Counter() for _ in range(4))
    for i, text, source, _ in rows:
        sizes[source] += size(text)
        null_size[source] += size(text) * (i is None)
    for r in got:
        taken[r["source"]] += size(r["text"])
        null_taken[r["source"]] += size(r["text"]) * (r["doc_id"] is None)
    order = sorted(sizes)
    goal = dict(zip(order, plain_targets([sizes[s] for s in order], [1, 2, 3, 1], sum(sizes.values()))))
    for s in order:
        assert abs(taken[s] - goal[s]) <= 0.1 * goal[s]
        assert abs(null_taken[s] - null_size[s] * goal[s] / sizes[s]) <= 0.2 * null_size[s] * goal[s] / sizes[s] + 40
    share = sum(r["n"] == -1 for r in got) / 600
    assert abs(share - goal["s1"] / sizes["s1"]) < 0.15
    assert max(collections.Counter(r["n"] for r in got if r["n"] >= 0).values()) <= 3


def test_many_equal_rows_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(M, "EQUAL_ROWS", 7)
    docs = spark.createDataFrame([(1, "a b c", "s")] * 100 + [(2, "d " * 300, "s"), (3, "e " * 90, None)], "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    assert len(got) == 102 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in ("s", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40


def test_resample_empty(none):
    assert M.resample(none).collect() == []
