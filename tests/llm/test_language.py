import zlib

import numpy as np
from brute import by_id, counted, read

from loomgraph.llm import language as L


def plain_grams(text, order):
    """Buckets of one text's n-grams, one at a time."""
    chars = [c if not c.isascii() or c.isalpha() else " " for c in text.lower()]
    out = []
    for i in range(len(chars) - order + 1):
        own = chars[i : i + order]
        if all(c == " " for c in own):
            continue
        code = order * 0x165667B1 & 0xFFFFFFFF
        for k, c in enumerate(own):
            code = (code ^ ord(c)) * int(L.MULTIPLIERS[k]) & 0xFFFFFFFF
            code ^= code >> 15
        out.append(code % L.BUCKETS)
    return out


def test_grams():
    texts = ["Ab c", "", "é!", "  ", "xyz", "a"]
    for order in L.ORDERS:
        buckets, offsets = L.grams(texts, order)
        assert [buckets[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [plain_grams(t, order) for t in texts]


def check(spark, folder):
    docs = read(spark, folder)
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 if r["doc_id"] is not None else False
    taught = [r for r in docs if not held(r) and r["lang"] is not None]
    langs = sorted({r["lang"] for r in taught})
    counts = np.full((len(langs), L.BUCKETS), 0.5)
    for r in taught:
        for order in L.ORDERS:
            np.add.at(counts[langs.index(r["lang"])], plain_grams(r["text"] or "", order), 1)
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    prior = np.log([sum(r["lang"] == x for r in taught) / len(taught) for x in langs])
    want = []
    for r in docs:
        text = r["text"] or ""
        total = prior + sum(log_p[:, plain_grams(text, o)].sum(axis=1) for o in L.ORDERS)
        lettered = any(c.isalpha() for c in text)
        want.append({"doc_id": r["doc_id"], "held_out": held(r), "lang_pred": langs[int(total.argmax())] if lettered else "und"})
    got = [r.asDict() for r in L.op3_language(spark, folder).collect()]
    assert counted(want, "doc_id", "held_out", "lang_pred") == counted(got, "doc_id", "held_out", "lang_pred")
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    return docs, got


def test_query(spark, small):
    docs, got = check(spark, small)
    true = {r["doc_id"]: r["lang"] for r in by_id(docs)}
    assert np.mean([true[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]) > 0.95


def test_odd(spark, saved, saved_none, none, odd):
    check(spark, saved)
    assert L.op3_language(spark, saved_none).collect() == []
    blank = L.train(none)
    assert blank.languages == [] and {r["lang_pred"] for r in L.identify(odd, blank).collect()} == {"und"}


def test_nothing_to_learn_from(spark, odd, none):
    unlabelled = odd.selectExpr(*[f"cast(null as string) as {c}" if c == "lang" else c for c in odd.columns])
    kept = L.keep_fitting(unlabelled, -3.0)
    assert kept.columns == odd.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in odd.collect() if any(map(str.isalpha, r["text"] or "")))
    assert L.keep_fitting(none, -3.0).collect() == []
