import re
from itertools import permutations

import duckdb
import pytest

from loomgraph.llm import audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = {letter for letter, x in {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}.items() if x}
        rows.append((source or "", failed, i in good, i in toxic))
    out, shapley = [], {}
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive, gone = own, []
            for k, f in enumerate(order):
                lost, kept = [r for r in alive if f in r[1]], [r for r in alive if f not in r[1]]
                out.append([part, order, k + 1, len(kept), len(lost), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)])
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
                alive, gone = kept, gone + lost
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_odd(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, 1, None), (30, None, 1), (31, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "'y' as good")
    upper = spark.createDataFrame([(50, "ABC def " * 60, "en", "", 1), (51, "ABC def " * 60, "en", "a", 1), (52, "one two $ " * 60, "en", "a", 1), (51, "ABC def " * 60, "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select(upper.columns).unionByName(upper)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    expected = brute(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert found(A.audit(docs.selectExpr("*", "'z' as part", "'w' as failed", "1 as n"), labels)) == expected
    assert len(expected) == 600 * len({r[2] or "" for r in rows})
    assert found(A.audit(docs, labels.where("false"))) == brute(rows, [])


def test_empty(spark, none):
    assert A.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("copies", [500])
def test_many_copies(spark, copies):
    docs = spark.createDataFrame([(i, "same text", f"s{i % 3}", ) for i in range(copies)] + [(None, "same text", "s0")] * 5, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 7 % 2) for i in range(copies)], "doc_id long, quality int, toxic int")
    assert found(A.audit(docs.repartition(5), labels)) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    told = con.execute(A.OP12_SQL)
    at = [[d[0] for d in told.description].index(c) for c in COLUMNS]
    got = found(A.op12_filter_audit(spark, small))
    assert got == sorted(tuple(r[i] for i in at) for r in told.fetchall())
    assert got == brute(con.execute("select doc_id, text, source from documents").fetchall(), con.execute("select doc_id, quality, toxic from labels").fetchall())
