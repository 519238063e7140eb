import numpy as np
from brute import counted, read, repeats, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import suffixes as X


def expected(spark, rows):
    """What the rows lose, in the operator's order of documents: by doc_id, nulls first, then by the text's hash."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(i, r["text"] or "") for i, r in enumerate(rows)], "i long, text string")
    marks = {r["i"]: r["m"] for r in texts.select("i", F.xxhash64("text").alias("m")).collect()}
    key = lambda i: (-(2**63) if rows[i]["doc_id"] is None else rows[i]["doc_id"], marks[i])
    unique = {key(i): rows[i]["text"] or "" for i in range(len(rows))}
    order = sorted(unique)
    gone = dict(zip(order, repeats([unique[k] for k in order])))
    out = []
    for i, r in enumerate(rows):
        data, lost = (r["text"] or "").encode(), gone[key(i)]
        spans = sum(lost[p] and (p == 0 or not lost[p - 1]) for p in range(len(lost)))
        out.append({"doc_id": r["doc_id"], "n_bytes": len(data), "n_removed": sum(lost), "n_spans": spans, "kept_sha256": sha(bytes(b for b, x in zip(data, lost) if not x))})
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def check(spark, folder):
    got = [r.asDict() for r in X.op8_suffix_dedup(spark, folder).collect()]
    assert counted(expected(spark, read(spark, folder)), *COLUMNS) == counted(got, *COLUMNS)


def test_query(spark, small):
    check(spark, small)


def test_odd(spark, saved, saved_none):
    check(spark, saved)
    assert X.op8_suffix_dedup(spark, saved_none).collect() == []


def test_frequent_passage_and_long_texts(spark, tmp_path, monkeypatch):
    """A passage in a third of the documents, texts longer than a piece, periodic texts, and matches across pieces."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    passage = " ".join(word() for _ in range(45))
    rows = []
    for i in range(240):
        own = " ".join(word() for _ in range(40))
        rows.append((i, f"{own[:120]} {passage[i % 7 :]} {own[120:]}" if i % 3 == 0 else own))
    rows += [(500, rows[4][1]), (501, "ab" * 400), (502, "x" * 950), (503, rows[0][1] + rows[1][1] + rows[2][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for piece in (4 << 20, 300):
        monkeypatch.setattr(X, "PIECE_BYTES", piece)
        check(spark, str(tmp_path))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6))
def test_runs_cover_all_windows(texts):
    parts = [t.encode() for t in texts if len(t) >= 12]
    if not parts:
        return
    r = X.runs(parts, 12, 5)
    seen = sorted((int(p), int(s) + k) for p, s, c in zip(r["piece"], r["start"], r["count"]) for k in range(c))
    assert seen == [(i, k) for i, p in enumerate(parts) for k in range(len(p) - 11)]
    # equal windows have equal anchors at equal offsets
    anchor = {}
    for p, s, c, o, g in zip(r["piece"], r["start"], r["count"], r["offset"], r["gram"]):
        for k in range(c):
            assert anchor.setdefault(parts[p][s + k : s + k + 12], (int(o) - k, int(g))) == (int(o) - k, int(g))


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="abc", min_size=20, max_size=120), st.sampled_from([8, 11, 16, 19]))
def test_multikey_quicksort(text, size):
    data = np.frombuffer(text.encode() + bytes(8), dtype=np.uint8)
    at = np.arange(len(text) - size + 1)
    part = X.multikey_quicksort(data, at, size)
    strings = [text[i : i + size] for i in at]
    assert all((strings[i] == strings[j]) == (part[i] == part[j]) for i in at for j in at)


def test_deduplicated_texts(spark, odd):
    got = {r["doc_id"]: r["text"] for r in X.deduplicate(odd).collect()}
    assert got[31] == "" and got[33] == "" and len(got[37]) < 200


def test_small_limits(spark):
    """Many small buckets, cut grams on most boundaries, sub-buckets, and all streams compacted again and again."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(150):
        own = " ".join(word() for _ in range(60))
        rows.append({"doc_id": i if i % 7 else None, "text": f"{own[:150]} {passage[i % 11 :]} {own[150:]}" if i % 3 == 0 else own})
    rows += [{"doc_id": 400 + i, "text": rows[i]["text"]} for i in range(20)]
    rows += [{"doc_id": 500, "text": "ab" * 400}, {"doc_id": 500, "text": "x" * 950}, dict(rows[3]), dict(rows[3]), {"doc_id": 501, "text": passage * 3}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(6)
    want = [{k: r[k] for k in ("doc_id", "n_bytes", "n_removed")} for r in expected(spark, rows)]
    for limits in (X.Limits(piece=400, batch=3000, bucket=1500, compact=600, ranges=16, sample=200, windows=300), X.Limits(bucket=4000, sample=400)):
        got = []
        for r in X.removal(docs, limits=limits).collect():
            n = len(r["text"].encode())
            gone = int(X.covered(n, np.array(r["codes"], dtype=np.int64), X.SIZE).sum()) if r["codes"] else 0
            got.append({"doc_id": None if r["doc"] == -(2**63) else r["doc"], "n_bytes": n, "n_removed": gone})
        assert counted(want, "doc_id", "n_bytes", "n_removed") == counted(got, "doc_id", "n_bytes", "n_removed")


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab", min_size=20, max_size=90), st.sampled_from([8, 11, 16]))
def test_multikey_quicksort_orders(text, size):
    data = np.frombuffer(text.encode() + bytes(8), dtype=np.uint8)
    at = np.arange(len(text) - size + 1)
    part = X.multikey_quicksort(data, at, size)
    strings = [text[i : i + size] for i in at]
    assert part.tolist() == [sum(t < s for t in strings) for s in strings]


def test_cut_grams():
    grams = np.frombuffer(b"".join(bytes([65 + i]) * X.GRAM for i in range(4)), np.uint8).reshape(-1, X.GRAM)
    for subs in (1, 3):
        buckets = X.Bucketing(grams[1:3], np.array([5, 9], dtype=np.uint64), subs)
        bucket, cut = buckets.of(grams[[0, 1, 1, 2, 2, 3]], np.array([7, 4, 6, 9, 8, 0], dtype=np.uint64))
        assert (bucket // subs).tolist() == [0, 0, 1, 2, 1, 2] and cut.tolist() == [False, True, True, True, True, False]
        assert bucket.max() < buckets.n
