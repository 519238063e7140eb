import random
import re

import brute
import duckdb
import pytest

from loomgraph.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    names |= windows[tuple(w[p : p + n])] - {None}
        out.append((i, len(w), len(hit), len(names), brute.sha(",".join(sorted(map(str, names)))), bool(hit)))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def digest(spark, docs, items, **options):
    found = D.decontaminate(docs, items, **options)
    return ordered((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(sorted(map(str, r["items"])))), r["n_hit"] > 0) for r in found.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    common = ["na", "la", "Été", "K9"]
    make = lambda n: " ".join(draw.choice(common) if draw.random() < 0.8 else f"w{draw.randrange(40)}" for _ in range(n))
    items = [(i, make(draw.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 25, 60]))) for i in range(30)] + [(3, make(20)), (None, make(12)), (77, None), (78, " .,; "), (79, "na " * 15)]
    docs = []
    for i in range(60):
        parts = [make(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            _, text = draw.choice(items)
            own = (text or "").split()
            a = draw.randrange(max(1, len(own) - 9))
            parts += [" ".join(own[a : a + draw.choice([9, 10, 14, 100])]).upper() if draw.random() < 0.3 else " ".join(own[a : a + 12]), make(draw.randrange(20))]
        docs.append((i if i % 9 else None, ("; " if i % 2 else " ").join(parts)))
    return docs + [docs[4]] * 3 + [(4, "other text"), (90, None), (91, ""), (92, " \n.! "), (93, "na " * 3000)], items


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("short", [True, False])
def test_against_plain(spark, texts, broadcast_bytes, short):
    docs, items = texts
    items = [x for x in items if short or len(words(x[1])) >= 10]
    frames = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as words", "'y' as hash").repartition(5), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as window", "'y' as length")
    assert digest(spark, *frames, broadcast_bytes=broadcast_bytes) == plain(docs, items)


def test_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(i, " ".join(words(rows[i][1])[i : i + 12])) for i in range(6)] + [(8, "déjà VU")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert digest(spark, odd, asked) == plain(rows, items)
    assert digest(spark, odd, asked.where("false")) == plain(rows, [])
    assert digest(spark, none, asked) == []


def test_no_python_in_the_plan(spark, small):
    plan = D.op13_decontamination(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    told = con.execute(D.OP13_SQL)
    at = [[d[0] for d in told.description].index(c) for c in COLUMNS]
    got = ordered(tuple(r[c] for c in COLUMNS) for r in D.op13_decontamination(spark, small).collect())
    assert got == ordered(tuple(r[i] for i in at) for r in told.fetchall())
    assert got == plain(con.execute("select doc_id, text from documents").fetchall(), con.execute("select item_id, text from benchmark").fetchall())
    assert any(r[2] for r in got) and not all(r[2] for r in got)
