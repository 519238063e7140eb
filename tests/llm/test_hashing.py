import numpy as np
import pyarrow as pa
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import common, hashing, simhash


@settings(deadline=None, max_examples=80)
@given(st.binary(min_size=1, max_size=60))
def test_ranges_hash_equal_when_bytes_are(data):
    roll = hashing.Rolling(3)
    array = np.frombuffer(data, np.uint8)
    prefix = roll.prefix(array)
    pairs = [(a, b) for a in range(len(data)) for b in range(a + 1, len(data) + 1)]
    starts, ends = (np.array(x) for x in zip(*pairs))
    seen = {}
    for (a, b), h in zip(pairs, roll.ranges(prefix, starts, ends).tolist()):
        assert seen.setdefault(data[a:b], h) == h
    assert len(set(seen.values())) == len(seen)
    size = min(4, len(data))
    whole = roll.windows(prefix, size)
    assert len(whole) == len(data) - size + 1 and len(set(whole.tolist())) == len({data[i : i + size] for i in range(len(whole))})


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="aé \t\n\x0b\x0c\r\x1c\x85 😀B", max_size=40))
def test_words(text):
    want = WORD.findall(text)
    assert common.words(text) == want
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = hashing.word_spans(data, simhash._BREAKS)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == want


def test_word_counts_on_the_jvm(spark):
    texts = ["a b", None, "", " \t", "é x y", "a\x1cb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(common.n_words(df["text"])).collect()] == [len(WORD.findall(t or "")) for t in texts]


def test_steps_lose_nothing():
    texts = ["x" * n for n in (0, 5, 50, 1, 7, 0, 200)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(common.steps(iter([batch, batch.slice(0, 0)]), "text", 40))
    assert len(parts) > 2 and [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert common.segment_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3, 3])).tolist() == [0, 3, 3, 0]
