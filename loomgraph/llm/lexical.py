"""Operator 11: ranked lexical search by windowed bucket scoring.

Items are taken in blocks of bounded vocabulary. For a block, each task turns its documents to windows of up to WINDOW
documents in doc_id order: an inverted index of the block's terms alone (a term's documents, as places in the window,
and how often they hold it) and the documents' lengths. The windows are written; counts of documents, terms and
postings are sums over them. Then each task goes through its windows: a posting's contribution is computed once, each
item's terms scatter their postings' contributions into an array of the window's size (64 KB) and mark the places in a bitset,
and the marked places are harvested into the item's heap of the k best, whose least score later documents must beat.
Texts are read once a block and never shuffled; a task hands on k documents an item.

Defined results: a document without terms (null, empty) isn't counted and is never found; rows that are there twice
are two documents; rows without doc_id are ranked as the largest ids; items of one item_id are one item of all their terms; an item
without terms, or that no document scores above 0 for, has no row; texts are taken whole, however long; empty tables
give no row; other columns are never looked at. An item's distinct terms, and those of a block, are held by every task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, steps
from loomgraph.session import cut, ship

K = 50
#: Documents and postings that a window holds at most (a document of more postings is a window of its own).
WINDOW, WINDOW_POSTINGS = 8192, 1 << 22
#: Pairs of item and term that a block of items holds, on average.
BLOCK_TERMS = 1 << 17
#: Saturation of a term's frequency, and share of the length in its norm, in the integer form of the score.
SCALE, TF_UNIT, NORM, LENGTH_PART = 1_000_000_000, 1000, 20, 50
#: Every byte that is in no term as a blank, A-Z as a-z; bytes of other letters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "docs long, terms_total long, ids binary, no_id binary, lengths binary, terms array<int>, counts array<int>, places binary, times binary"
NO_ID = 2**63 - 1


def terms(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return data.translate(_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each item's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms(text or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, term binary").distinct()


class Posted:
    """Documents that become one window."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, found: list[bytes], vocabulary: dict[bytes, int]) -> None:
        counted = Counter(found)
        common = list(vocabulary.keys() & counted.keys())
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.codes.append(np.array([vocabulary[t] for t in common], dtype=np.int32))
        self.times.append(np.array([counted[t] for t in common], dtype=np.int64))
        self.postings += len(common)

    def row(self) -> pa.RecordBatch:
        """Postings by term, a term's in ascending doc_id."""
        ids = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)
        no_id = np.array([i is None for i in self.ids], dtype=np.uint8)
        order = np.lexsort((no_id, ids))
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        places = np.repeat(place, [len(c) for c in self.codes])
        by = np.lexsort((places, codes))
        found, counts = np.unique(codes, return_counts=True)
        values = [len(ids), int(sum(self.lengths)), ids[order].tobytes(), no_id[order].tobytes(), np.array(self.lengths, dtype=np.int64)[order].tobytes(), found, counts.astype(np.int32), places[by].tobytes(), times[by].tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """INDEX: windows of documents with the postings of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = shared.value, Posted()
        for batch in steps(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(text.as_py() or b"")
                if found:
                    now.add(doc_id, found, known)
                if len(now.ids) >= WINDOW or now.postings >= WINDOW_POSTINGS:
                    yield now.row()
                    now = Posted()
        if now.ids:
            yield now.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m for each length: 100 - 50 + 50 x length x documents div terms, exact at any size."""
    if int(lengths.max(initial=0)) * LENGTH_PART * n_docs < 2**63:
        return 100 - LENGTH_PART + lengths * (LENGTH_PART * n_docs) // n_terms
    return np.array([100 - LENGTH_PART + LENGTH_PART * x * n_docs // n_terms for x in lengths.tolist()], dtype=np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """A heap of the k best of an item: higher scores, and of equal ones smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """scores in ascending order of ids; those of 0 and below don't count."""
        keep = np.flatnonzero(scores >= (self.heap[0][0] if len(self.heap) == self.k else 1))
        if len(keep) > self.k:
            least = np.partition(scores[keep], len(keep) - self.k)[len(keep) - self.k]
            over, ties = keep[scores[keep] > least], keep[scores[keep] == least]
            keep = np.concatenate([over, ties[: self.k - len(over)]])
        for j in keep.tolist():
            entry = (int(scores[j]), -int(no_id[j]), -int(ids[j]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            else:
                heapq.heappushpop(self.heap, entry)


def score_windows(windows: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place in items), doc_id, score: each task's k best of each item."""
    shared = windows.sparkSession.sparkContext.broadcast(([codes for _, codes in items], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        bucket, marked = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, no_id, lengths, codes, counts, places, times = (batch.column(c)[r] for c in range(7))
                ids, lengths, times = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, lengths, times))
                no_id, places = np.frombuffer(no_id.as_buffer(), np.uint8), np.frombuffer(places.as_buffer(), np.int32)
                codes, counts = codes.values.to_numpy(), counts.values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(counts)])
                if len(bucket) < len(ids):
                    bucket, marked = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
                norm = norms(lengths, n_docs, n_terms)
                gain = np.repeat(weights[codes], counts) * ((SCALE * times) // (TF_UNIT * times + NORM * norm[places]))
                for own, heap in zip(asked, best):
                    at = np.searchsorted(codes, own)
                    at = at[(at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == own)] if len(codes) else at[:0]
                    for j in at.tolist():
                        part = places[starts[j] : starts[j + 1]]
                        bucket[part] += gain[starts[j] : starts[j + 1]]  # a term has a document once
                        marked[part] = True
                    touched = np.flatnonzero(marked[: len(ids)])
                    heap.harvest(bucket[touched], ids[touched], no_id[touched])
                    bucket[touched], marked[touched] = 0, False
        found = [(n, None if e[1] else -e[2], e[0]) for n, heap in enumerate(best) for e in heap.heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], ["item", "doc_id", "score"])

    return windows.select("ids", "no_id", "lengths", "terms", "counts", "places", "times").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item that score above 0."""
    spark = docs.sparkSession
    ship(spark)
    asked = cut(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # BLOCK_TERMS rows, or one item's terms
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r["item_id"], []).append(vocabulary[bytes(r["term"])])
        own = [(i, np.array(sorted(of[i]), dtype=np.int32)) for i in sorted(of, key=lambda i: (i is None, i or 0))]
        windows = cut(index(docs, vocabulary), "postings")
        total = windows.agg(F.sum("docs"), F.sum("terms_total")).first()
        if not own or not total[0]:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for code, n in windows.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts")).collect():  # a row a term of the block
            df[code] = n
        weights = np.array([weight(total[0], int(x)) for x in df], dtype=np.int64)
        best = score_windows(windows, own, weights, int(total[0]), int(total[1]), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], "item int, item_id long")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score", F.pmod(F.spark_partition_id(), F.lit(64)).alias("some")))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = together.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "some").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in DuckDB SQL.
OP11_SQL = r"""
with t as (
  select row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as row, doc_id, text from documents)),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
n as (select row, doc_id, count(*) as n from t group by all),
s as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from n),
tf as (select row, term, count(*) as tf from t semi join q using (term) group by all),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by term, docs),
m as (select row, doc_id, 50 + (50 * n * docs) // terms as m from n, s),
r as (
  select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (row) group by all having sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) > 0),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from r)
select item_id, rank, doc_id, score from k where rank <= 50
"""
