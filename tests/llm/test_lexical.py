import math
import re
from collections import Counter

import duckdb
import pytest

from loomgraph.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms, df = len(held), sum(c.total() for _, c in held), Counter()
    for _, c in held:
        df.update(c.keys())
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, own in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(i, n + 1, None if no else d, -s) for n, (s, no, d) in enumerate(sorted(scored)[:k])]
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(df):
    return ordered((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def pairs(df, name):
    return [(r[name], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The and OF 'in' naïve"), (1, "him been"), (2, None), (3, "+ - !"), (4, "zzz nowhere"), (5, "x" * 70000), (None, "déjà VU déjà"), (7, "has who will ending 3"), (7, "has who will ending 3")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as term", "'y' as item")


@pytest.mark.parametrize("window,postings,block", [(8192, 1 << 22, 1 << 17), (3, 1 << 22, 4), (100, 20, 1)])
def test_odd(spark, odd, items, monkeypatch, window, postings, block):
    for name, value in {"WINDOW": window, "WINDOW_POSTINGS": postings, "BLOCK_TERMS": block}.items():
        monkeypatch.setattr(L, name, value)
    docs = odd.repartition(3)
    for k in (2, 50):
        assert found(L.search(docs, items, k)) == brute(pairs(odd, "doc_id"), pairs(items, "item_id"), k)


def test_empty(spark, odd, none, items):
    for docs, asked in ((none, items), (odd, items.where("false")), (none, items.where("false"))):
        assert L.search(docs, asked).collect() == []


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    got = found(L.op11_ranked_search(spark, small))
    assert got == ordered(con.execute(L.OP11_SQL).fetchall())
    assert got == brute(con.execute("select doc_id, text from documents").fetchall(), con.execute("select item_id, text from benchmark").fetchall())


def test_sizes_beyond_64_bits():
    import numpy as np

    lengths = np.array([1, 10**9], dtype=np.int64)
    assert L.norms(lengths, 10**11, 10**14).tolist() == [50 + 50 * 10**11 // 10**14, 50 + 50 * 10**20 // 10**14]
