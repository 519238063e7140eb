import numpy as np
from brute import WORD, read

from loomgraph.llm import neardup as N
from loomgraph.llm import resemblance as R


def shingles(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def roots(sets):
    """For each set the first one that it reaches, by comparing all pairs."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_stage_keeps_one_of_all_that_are_alike(spark, small):
    rows = sorted(read(spark, small), key=lambda r: r["doc_id"])
    root = roots([shingles(r["text"]) for r in rows])
    want = {rows[i]["doc_id"] for i in root}
    kept = [r["doc_id"] for r in N.keep_first(spark.read.parquet(f"{small}/documents.parquet")).collect()]
    assert sorted(kept) == sorted(want)
    assert not {1, 177} <= set(kept)  # 0.83 of their shingles are common; nine of 64 SimHash bits differ


def test_groups_are_exact():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 400, 60) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.2, rng.integers(0, 400, 60), base[k % 12])).astype(np.uint64) for k in range(150)]
    assert R.groups(sets).tolist() == roots([set(s.tolist()) for s in sets])


def test_shingles():
    texts = ["", "One  two", "one two", "a b c d e f", "A b\tc d e F", " \n", "a b c d e"]
    sets = [s.tolist() for s in R.shingle_sets(texts)]
    assert sets[0] == sets[5] == [0] and sets[1] == sets[2] and sets[3] == sets[4] and len(sets[3]) == 2 and set(sets[6]) < set(sets[3])


def families(rng, n, variants, words=60, changed=4):
    """Texts of n families, whose members differ in a few words; and where each one's family is."""
    out = []
    for f in range(n):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
        for _ in range(variants):
            own = list(base)
            for k in rng.integers(0, words, rng.integers(0, changed)):
                own[k] = f"x{rng.integers(0, 5000)}"
            out.append(" ".join(own))
    return out


def test_large_clusters_are_compared_in_blocks(spark):
    """Clusters of more shingles than a task takes: the same components as by comparing all pairs, of all points of a band."""
    texts = list(dict.fromkeys(families(np.random.default_rng(2), 4, 40)))
    sets = R.shingle_sets(texts)
    found = spark.createDataFrame([(0, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "cluster long, point long, n long, shingles binary")
    band = spark.createDataFrame([(i, i % 2) for i in range(len(sets))] + [(i, 7) for i in range(len(sets))], "point long, band long")
    want = R.groups(sets)
    for most in (300, 1500, 10**6):
        got = {r["point"]: r["root"] for r in R.links(band, found, most).collect()}
        mine, theirs = {}, {}
        for i in range(len(sets)):
            mine.setdefault(got.get(i, i), set()).add(i)
            theirs.setdefault(int(want[i]), set()).add(i)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values())), most


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_SHINGLES", 400)
    texts = families(np.random.default_rng(5), 3, 60) + ["alone " + str(i) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    root = roots([shingles(t) for t in texts])
    assert sorted(r["doc_id"] for r in N.keep_first(docs).collect()) == sorted(set(root))
