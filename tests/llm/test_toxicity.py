import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import toxicity as T


def quality(got, labels):
    own = [(r["toxic"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    hit = sum(t and y for t, y in own)
    return hit / max(1, sum(y for _, y in own)), hit / max(1, sum(t for t, _ in own))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = T.op9_toxicity(spark, folder).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == 1000
    recall, precision = quality(got, labels)
    assert recall > 0.9 and precision > 0.9


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = T.train(docs, labels.where("doc_id % 3 <> 0"), T.CATEGORIES)
    rest = docs.join(labels.where("doc_id % 3 = 0"), "doc_id", "left_semi")
    got = T.classify(rest, chain).selectExpr("doc_id", "p_toxic >= 0.5 as toxic").collect()
    recall, precision = quality(got, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    assert recall > 0.9 and precision > 0.95


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(24)] + [(24, None, 1), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = T.classify(odd, T.train(odd, labels, T.CATEGORIES)).collect()
    assert len(got) == odd.count() and all(0 <= r["p_poor"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)
    assert len({(r["p_poor"], r["p_toxic"]) for r in got if r["doc_id"] in (33, 34)}) == 1
    unlabelled = T.classify(odd, T.train(odd, labels.where("false"), T.CATEGORIES)).collect()
    assert max(r["p_toxic"] for r in unlabelled) < 1e-6
    same = T.classify(odd, T.train(odd, labels.selectExpr("doc_id", "1 as quality", "1 as toxic"), T.CATEGORIES)).collect()
    assert min(r["p_toxic"] for r in same) > 0.99
    assert T.classify(none, T.train(none, labels, T.CATEGORIES)).collect() == []


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.integers(0, 2, n).astype(float)
    rows, cols = np.flatnonzero(first), np.zeros(int(first.sum()), dtype=int)
    alone = T.fit(rows, cols, first, np.zeros((n, 0)), 1)
    p = alone.score(rows, cols, n, np.zeros((n, 0)))
    assert ((p > 0.5) == (first == 1)).all()
    chained = T.fit(np.zeros(0, int), np.zeros(0, int), first, p[:, None], 1)
    assert chained.earlier[0] > 1


def test_features_are_words_and_beginnings():
    rows, buckets = T.features(["Hello hello", "", "HELLO, x", "help"])
    assert set(buckets[rows == 0]) == set(buckets[(rows == 2)]) - set(T.features(["x"])[1]) and not (rows == 1).any()
    assert len(set(buckets[rows == 0])) == 2  # the word, and its first four bytes


def plain_chain(texts, y, fold, categories, folds, most):
    """The same chain by dense matrices and plain loops: presence of words and beginnings, chi-square, logistic models, out-of-fold columns."""
    present = [sorted(set(T.features([t])[1].tolist())) for t in texts]

    def chosen(rows):
        scores = {}
        for k in range(len(categories)):
            ones = sum(y[r][k] for r in rows)
            if not 0 < ones < len(rows):
                continue
            seen, hits = {}, {}
            for r in rows:
                for b in present[r]:
                    seen[b] = seen.get(b, 0) + 1
                    hits[b] = hits.get(b, 0) + y[r][k]
            for b, n in seen.items():
                if 2 <= n < len(rows):
                    chi = len(rows) * (hits[b] * len(rows) - n * ones) ** 2 / (n * (len(rows) - n) * ones * (len(rows) - ones))
                    scores[b] = max(scores.get(b, 0), chi)
        return sorted(sorted((b for b in scores if scores[b] > 0), key=lambda b: (-scores[b], b))[:most])

    def matrix(rows, buckets, earlier):
        own = np.array([[b in set(present[r]) for b in buckets] for r in rows], dtype=float).reshape(len(rows), len(buckets))
        return np.column_stack([own, earlier[rows], np.ones(len(rows))])

    def fitted(x, target):
        w = np.zeros(x.shape[1])
        if target.min() == target.max():
            w[-1] = np.log(max(target.mean(), 1e-9) / max(1 - target.mean(), 1e-9))
            return w
        w[-1] = np.log(target.mean() / (1 - target.mean()))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 251):
            g = x.T @ (1 / (1 + np.exp(-x @ w)) - target)
            g[:-1] += 0.02 * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    everyone = list(range(len(texts)))
    earlier, applied, models = np.zeros((len(texts), 0)), np.zeros((len(texts), 0)), []
    for k in range(len(categories)):
        buckets = chosen(everyone)
        w = fitted(matrix(everyone, buckets, earlier), y[:, k])
        column, out = 1 / (1 + np.exp(-matrix(everyone, buckets, applied) @ w)), np.zeros(len(texts))
        for f in range(folds):
            seen, own = [r for r in everyone if fold[r] != f], [r for r in everyone if fold[r] == f]
            if own:
                fewer = chosen(seen)
                out[own] = 1 / (1 + np.exp(-matrix(own, fewer, earlier) @ fitted(matrix(seen, fewer, earlier), y[seen, k])))
        earlier, applied = np.column_stack([earlier, out]), np.column_stack([applied, column])
    return applied


def test_against_a_plain_chain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(90)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 or length(text) % 5 = 0 as int) as quality", "cast(instr(lower(text), 'on') > 0 and doc_id % 7 < 5 as int) as toxic")
    rows = docs.join(labels, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))).orderBy("doc_id").collect()
    y = np.array([[1 - r["quality"], r["toxic"]] for r in rows], dtype=float)
    assert 0 < y[:, 1].sum() < len(y)
    want = plain_chain([r["text"] or "" for r in rows], y, [r["fold"] for r in rows], list(T.CATEGORIES), 3, 40)
    chain = T.train(docs, labels, T.CATEGORIES, most_features=40)
    got = {r["doc_id"]: (r["p_poor"], r["p_toxic"]) for r in T.classify(docs, chain).collect()}
    assert np.abs(np.array([got[r["doc_id"]] for r in rows]) - want).max() < 1e-6


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    seen, chained = [], T.chained
    monkeypatch.setattr(T, "chained", lambda rows, cols, y, *rest: seen.append(len(y)) or chained(rows, cols, y, *rest))
    texts = [(7, f"awful words number {i}") for i in range(500)] + [(i, "kind words") for i in range(100, 140)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0, 1)] + [(i, 1, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    chain = T.train(docs, labels, T.CATEGORIES, most_labelled=300)
    T.train(docs, labels, T.CATEGORIES, most_labelled=600)
    assert seen == [300, 540]
    got = {r["doc_id"]: r["p_toxic"] for r in T.classify(docs, chain).collect()}
    assert len(got) == 41 and all(0 <= p <= 1 for p in got.values())
