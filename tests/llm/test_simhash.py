import numpy as np
from brute import WORD, by_id, counted, read, sha

from loomgraph.llm import simhash as S


def check(spark, folder):
    docs = by_id(read(spark, folder))
    want = []
    for i, r in enumerate(docs):
        text, after = r["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        half = len(text) // 2
        want.append({"doc_id": r["doc_id"], "n_chars": len(text), "edited_sha256": sha(text[: len(text) - half] + after[:half])})
    got = [r.asDict() for r in S.op2_fingerprints(spark, folder).collect()]
    assert counted(want, "doc_id", "n_chars", "edited_sha256") == counted(got, "doc_id", "n_chars", "edited_sha256")
    prints = {}
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] or "" for r in docs}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(texts[r["doc_id"], r["n_chars"]], r["fingerprint"]) == r["fingerprint"]
    return got


def test_query(spark, small):
    got = check(spark, small)
    assert np.mean([r["near_edited"] for r in got]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in got])


def test_odd(spark, saved, saved_none):
    got = check(spark, saved)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (32, 33, 34)} == {"0" * (S.BITS // 4)}
    assert S.op2_fingerprints(spark, saved_none).collect() == []


def test_votes_are_majorities():
    texts = [b"a b c d e f", b"", b"solo", b"a b c d e f"]
    hashes, offsets = S.term_hashes(texts)
    assert np.diff(offsets).tolist() == [5, 0, 1, 5]
    prints = S.votes(hashes, offsets)
    for i in range(len(texts)):
        own = hashes[offsets[i] : offsets[i + 1]]
        for lane in range(S.BITS // 64):
            mixed = S.mix64(own ^ S._LANES[lane % 2] ^ np.uint64(lane // 2))
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1)
            assert (np.packbits(2 * bits.sum(axis=0, dtype=int) > len(own)) == prints[i, lane * 8 : lane * 8 + 8]).all() or not len(own)
    assert (prints[0] == prints[3]).all()


def test_column_sums():
    bits = np.random.default_rng(0).integers(0, 2, (1000, 64)).astype(np.uint8)
    assert (S.column_sums(bits) == bits.sum(axis=0, dtype=int)).all()


def test_near_search_is_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (60, S.BITS // 8)).astype(np.uint8)
    rows = [base]
    for _ in range(4):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.integers(0, S.BITS, rng.integers(0, 6)):
                other[i, b // 8] ^= 1 << (b % 8)
        rows.append(other)
    prints = np.concatenate(rows)
    df = spark.createDataFrame([(i, p.tobytes().hex()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    for radius in (0, 3):
        got = {(r["query_id"], r["doc_id"], r["distance"]) for r in S.search(df.where("doc_id % 10 = 0"), df, radius).collect()}
        d = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
        assert got == {(i, j, int(d[i, j])) for i in range(0, len(prints), 10) for j in range(len(prints)) if i != j and d[i, j] <= radius}


def test_parts_of_few_and_many_bounds(spark):
    import bisect

    ids = spark.range(-50, 60_000, 997).selectExpr("id as sort_id", "substring('abcdéz', cast(pmod(id, 6) as int) + 1, 1) as lead")
    few = [(i, "") for i in (-(2**63), -3, 0, 500, 40_000)]
    for bounds in ([], few, [(i, "") for i in range(0, 50_000, 10)], sorted([*few, (947, "b"), (947, "é"), (1944, "'")]), sorted([*((i, "") for i in range(0, 50_000, 10)), (947, "c"), (947, "é")])):
        got = ids.select("sort_id", "lead", S._part_of(bounds).alias("part")).collect()
        marks = [(i, t.encode()) for i, t in bounds]
        assert all(r["part"] == bisect.bisect_right(marks, (r["sort_id"], r["lead"].encode())) for r in got)


def test_an_id_that_many_rows_share_is_cut(spark, tmp_path):
    """Two thirds of the rows have no id: they are several parts, and each one's next document is still the next by text."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 4)))
    rows = [(None if i % 3 else i, " ".join(word() for _ in range(rng.integers(1, 12)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    parts = S.with_parts(docs).where("not guest and doc_id is null").groupBy("part").count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 150
    own = by_id(read(spark, str(tmp_path)))
    want = []
    for i, r in enumerate(own):
        text, after = r["text"], own[(i + 1) % len(own)]["text"]
        want.append({"doc_id": r["doc_id"], "edited_sha256": sha(text[: len(text) - len(text) // 2] + after[: len(text) // 2])})
    got = [r.asDict() for r in S.op2_fingerprints(spark, str(tmp_path)).collect()]
    assert counted(want, "doc_id", "edited_sha256") == counted(got, "doc_id", "edited_sha256")


def plain_print(text):
    """The fingerprint bit by bit: word pairs, each hashed from its words' hashes, vote as often as they occur."""
    words = WORD.findall(text)
    roll = S.rolling()

    def hashed(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return roll.ranges(roll.prefix(data), np.array([0]), np.array([len(data)]))

    one = [hashed(w) for w in words]
    terms = [int(S.mix64(a * S._PAIR + b)[0]) for a, b in zip(one, one[1:])] if len(one) > 1 else [int(x[0]) for x in one]
    out = []
    for bit in range(S.BITS):
        lane = int(S._LANES[bit // 64])
        mixed = [int(S.mix64(np.array([t ^ lane], dtype=np.uint64))[0]).to_bytes(8, "little") for t in terms]
        votes = sum(1 if m[bit % 64 // 8] >> (7 - bit % 8) & 1 else -1 for m in mixed)
        out.append(votes > 0)
    return np.packbits(out)


def test_query_against_plain_fingerprints(spark, tmp_path):
    """fingerprint, likenesses and n_near of the query, from one bit a time and all pairs."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 4)))
    base = [" ".join(word() for _ in range(30)) for _ in range(8)]
    rows = [(i * 25, base[i % 8] + (" tail" if i % 5 == 0 else "")) for i in range(40)] + [(1001, None), (1002, "one"), (1100, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op2_fingerprints(spark, str(tmp_path)).collect()}
    rows.sort()
    texts = [t or "" for _, t in rows]
    prints = [plain_print(t) for t in texts]
    near = np.bitwise_count(np.array(prints)[:, None, :] ^ np.array(prints)[None, :, :]).sum(axis=2)
    for i, (doc_id, _) in enumerate(rows):
        after = (i + 1) % len(rows)
        half = len(texts[i]) // 2
        edited = plain_print(texts[i][: len(texts[i]) - half] + texts[after][:half])
        alike = lambda a, b: max(0.0, np.cos(np.pi * np.bitwise_count(a ^ b).sum() / S.BITS))
        r = got[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[i].tobytes().hex(), edited.tobytes().hex()), doc_id
        assert abs(r["near_edited"] - alike(prints[i], edited)) < 1e-12 and abs(r["near_next"] - alike(prints[i], prints[after])) < 1e-12
        assert r["n_near"] == (int((near[i] <= S.RADIUS).sum()) - 1 if doc_id % S.STRIDE == 0 else None)
