import random
import zlib

import numpy as np
import pytest
from brute import by_id, counted, read
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import tokenfile as T


def check(spark, folder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(T.DEFAULT_TOKENIZER)
    start, want = 0, []
    for r in by_id(read(spark, folder)):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, T.END_ID]
        want.append({"doc_id": r["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    got = [r.asDict() for r in T.op4_token_files(spark, folder).collect()]
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert counted(want, *columns) == counted(got, *columns)


def test_query(spark, small):
    check(spark, small)


def test_odd(spark, saved, saved_none):
    check(spark, saved)
    assert T.op4_token_files(spark, saved_none).collect() == []


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(2, 4))
def test_blocks_round_trip(ids, least):
    seq, rules = T.compress(np.array(ids, dtype=np.uint32), 10, passes=5, least=least)
    block = T.Block(10, rules, T.expansion_lengths(rules, 10), seq, [], np.zeros(0))
    assert block.ids().tolist() == ids
    assert block.lengths.tolist() == [len(block.expand(np.array([10 + i]))) for i in range(len(rules))]


def test_random_access_and_compression():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40, n) for n in (0, 5, 3000, 1, 700)] + [np.tile(np.arange(30), 200)] * 3
    lengths = np.array([len(d) for d in docs])
    payload = T.write_block(np.concatenate(docs).astype(np.uint32), [None, *range(1, len(docs))], lengths, 50)
    block = T.read_block(payload)
    assert block.doc_ids == [None, *range(1, len(docs))] and len(block.rules) and len(block.seq) < 0.4 * lengths.sum()
    for i, d in enumerate(docs):
        assert block.document(i).tolist() == d.tolist()
    with pytest.raises(ValueError):
        T.read_block(b"XXXX" + payload[4:])


def test_words_and_library_agree():
    with open(T.DEFAULT_TOKENIZER, "rb") as file:
        encoder = T.Encoder(file.read())
    assert encoder.by_words
    texts = ["Don't DON'T it's 'stupid' !'s a1b22c --- É Straße ŒUVRE ŉ İstanbul ſ", "tabs\tand\x0bothers   x", "ª ² ③ 日本", "a<|endoftext|>b", "'s't're've'm'll'd", "été été", "a\x1cb\x85c"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_are_read_back(spark, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(T.DEFAULT_TOKENIZER)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 30")
    got = {r["doc_id"]: r["ids"] for r in T.read_ids(spark, T.write_token_files(docs)).collect()}
    assert got == {r["doc_id"]: [*lib.encode(r["text"] or "", add_special_tokens=False).ids, T.END_ID] for r in docs.collect()}


def test_random_texts_as_the_library_has_them(monkeypatch):
    with open(T.DEFAULT_TOKENIZER, "rb") as file:
        encoder = T.Encoder(file.read())
    rng = random.Random(5)
    alphabet = "ab'sSTtrevmld09 .!\n\t'\"-_Éßàſŉİ×÷日 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)] + ["", "'", "''s", "!'s", "a'sb", "'ll'll", "'re've", "9's9", "abba" * 400]
    want = [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1 << 20, 3000, 50):  # with room, and forgetting all words again and again
        monkeypatch.setattr(T, "MOST_WORDS", most)
        for k in range(0, len(texts), 150):
            assert [x.tolist() for x in encoder.encode(texts[k : k + 150])] == want[k : k + 150]
    assert encoder.encode([]) == []


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 4), max_size=400), st.integers(2, 6))
def test_no_pair_is_left_that_is_frequent(ids, least):
    seq, rules = T.compress(np.array(ids, dtype=np.uint32), 10, least=least)
    block = T.Block(10, rules, T.expansion_lengths(rules, 10), seq, [], np.zeros(0))
    assert block.ids().tolist() == ids
    counts, last = {}, None
    for i, pair in enumerate(zip(seq.tolist(), seq.tolist()[1:])):  # occurrences that don't overlap
        if last == (i - 1, pair):
            continue
        counts[pair], last = counts.get(pair, 0) + 1, (i, pair)
    assert all(n < least for n in counts.values())
