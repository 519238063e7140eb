import base64
import collections
import random
import string

import corpus_pipeline as C
from brute import read, secrets, sha
from test_resemblance import roots, shingles

from pyspark.sql import functions as F

from loomgraph.llm import mixing, pieces
from loomgraph.llm import secrets as S


def staged(spark, docs, folder, upto):
    for _, stage in C.STAGES[:upto]:
        docs = stage(spark, docs, folder)
    return docs


def test_stages_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = C.STAGES[0][1](spark, docs, small)
    assert first.columns == docs.columns
    rows = [r.asDict() for r in first.collect()]
    before = {r["doc_id"]: r for r in read(spark, small)}
    # all texts here have letters of a clear language
    assert {r["doc_id"] for r in rows} == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}

    second = C.STAGES[1][1](spark, first, small)
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    kept = {ordered[i]["doc_id"] for i in roots([shingles(r["text"]) for r in ordered])}  # five words, 0.8
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(kept)

    third = C.STAGES[2][1](spark, second, small)
    cleaned = {r["doc_id"]: r for r in third.collect()}
    assert third.columns == docs.columns and set(cleaned) == kept
    for i, r in cleaned.items():
        assert not secrets(r["text"]) and r["n_chars"] == len(r["text"])
        if not S.Scanner(S.RULES).scan([before[i]["text"]])[0]:
            assert r["text"] == before[i]["text"]

    fourth = C.STAGES[3][1](spark, third, small)
    copies = collections.Counter(r["doc_id"] for r in fourth.collect())
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(third).collect()}
    assert fourth.columns == docs.columns
    for i, (size, words) in taken.items():
        assert words // max(1, size) <= copies[i] <= -(-words // max(1, size)) <= 3

    codec = pieces.Codec(pieces.read_model(pieces.DEFAULT_MODEL))
    want = collections.Counter()
    for i, n in copies.items():
        ids = codec.lib.encode(cleaned[i]["text"])
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(codec.lib.decode(ids)))] = n
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in C.run(spark, small).collect())
    assert got == want


def test_odd(spark, odd, none, saved):
    for df, full in ((odd, True), (none, False)):
        docs = df
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, saved)
            assert docs.columns == df.columns, name
        assert (C.STAGES[-1][1](spark, docs, saved).count() > 0) is full
    kept = {r["doc_id"] for r in staged(spark, odd, saved, 1).collect()}
    assert not kept & {32, 33, 34, 35}


def test_columns_of_the_stages_own_names(spark, odd, saved):
    """Columns that a stage would add itself come out as they went in."""
    names = ["_kept", "__kept", "mix_id", "mix_copies", "mix_copy", "_lang_pred", "_lang_score", "_LANG_FIT", "row", "point", "n"]
    docs = odd
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, out, saved)
        assert out.columns == docs.columns, name
        rows = out.select(names).distinct().collect()
        assert [r.asDict() for r in rows] == [{n: f"own {n}" for n in names}], name


def test_language_stage_rejects_texts_of_no_language(spark):
    """Random letters and base64 go; every lettered document, single words too, stays."""
    small = "/root/testdata/sf0.01"
    rng = random.Random(3)
    junk = ["".join(rng.choice(string.ascii_lowercase + "   ") for _ in range(400)) for _ in range(10)]
    junk += [base64.b64encode(rng.randbytes(300)).decode() for _ in range(10)] + ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)) for _ in range(5)]
    clean = spark.read.parquet(f"{small}/documents.parquet")
    words = sorted({w for r in clean.select("text").collect() for w in (r["text"] or "").split() if w.isalpha()})[::397]
    rows = [(10**6 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)] + [(2 * 10**6 + i, w, "en", "word", len(w)) for i, w in enumerate(words)]
    docs = clean.unionByName(spark.createDataFrame(rows, clean.schema))
    kept = {r["doc_id"] for r in C.STAGES[0][1](spark, docs, small).select("doc_id").collect()}
    assert not {10**6 + i for i in range(len(junk))} & kept
    lettered = {r["doc_id"] for r in clean.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert lettered | {2 * 10**6 + i for i in range(len(words))} <= kept


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is C.run and [k for k, _ in C.STAGES] == ["language", "near_dedup", "secrets", "mixing", "sentencepiece"]
