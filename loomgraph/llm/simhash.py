"""Operator 2: SimHash fingerprints and their search through permuted block tables.

The terms of a text are its adjacent word pairs (a text of one word has that word); a term weighs as
often as it occurs. Each bit of a term's hash votes for or against that bit of the fingerprint.
Fingerprints within radius r differ in at most r bits, so of r + 1 blocks of bits at least one is
equal: each of r + 1 tables is keyed by one block, brought to the front, and a search compares the
fingerprints of one key only. What stays equal after that is decided by counting bits.

Defined results: null and empty texts, and texts of blanks, have the fingerprint of all zeros and are
alike among themselves; the likeness of two fingerprints is the cosine that their differing bits
stand for, 0 at least; rows with equal doc_id follow one another by text, null doc_ids come first;
the next document of the last one is the first; a text of any length is read whole, by one task; an empty table
gives no row; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import STEP_BYTES, WORD_BREAKS, documents, id_key
from loomgraph.llm.hashing import Rolling, mix64, word_spans
from loomgraph.session import cut, ship, shuffle_width

BITS = 128
_BREAKS = np.array([chr(b) in WORD_BREAKS for b in range(256)])
_ROLLING: list[Rolling] = []
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LANES = [np.uint64(0), np.uint64(0xA0761D6478BD642F)]


def rolling() -> Rolling:
    if not _ROLLING:
        _ROLLING.append(Rolling(7))
    return _ROLLING[0]


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts and the n + 1 offsets of the texts' terms."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    starts, ends = word_spans(data, _BREAKS)
    hashes = rolling().ranges(rolling().prefix(data), starts, ends)
    edges = np.concatenate([[0], np.searchsorted(starts, ends_of)])
    counts = np.diff(edges)
    pairs = hashes.copy()
    if len(hashes) > 1:
        pairs[:-1] = mix64(hashes[:-1] * _PAIR + hashes[1:])
        alone = edges[:-1][counts == 1]  # a text of one word: the word after it is another text's
        pairs[alone] = hashes[alone]
    keep = np.ones(len(hashes), dtype=bool)
    last = edges[1:][counts > 1] - 1  # the last word of a text begins no pair, unless it is alone
    keep[last] = False
    offsets = np.concatenate([[0], np.cumsum(counts - (counts > 1))])
    return pairs[keep], offsets


def votes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints (texts x BITS / 8 bytes): the bits that more than half of the terms' hashes set."""
    out = np.zeros((len(offsets) - 1, BITS // 8), dtype=np.uint8)
    for lane in range(BITS // 64):
        bits = np.unpackbits(mix64(hashes ^ _LANES[lane % 2] ^ np.uint64(lane // 2)).view(np.uint8).reshape(-1, 8), axis=1)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b > a:
                out[i, lane * 8 : lane * 8 + 8] = np.packbits(2 * column_sums(bits[a:b]) > b - a)
    return out


def column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of the columns of a 0/1 matrix of bytes, 255 rows at a time within bytes."""
    n = len(bits) // 255 * 255
    total = bits[n:].sum(axis=0, dtype=np.int64)
    if n:
        # summing bytes eight to a word keeps every addition within the byte
        words = np.ascontiguousarray(bits[:n]).view(np.uint64).reshape(n // 255, 255, -1)
        total += np.add.reduce(words, axis=1).view(np.uint8).reshape(n // 255, bits.shape[1]).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(texts: list[bytes]) -> np.ndarray:
    return votes(*term_hashes(texts))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits estimates, 0 at least."""
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * differ / BITS))


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Characters of a text that bounds between rows of one id look at.
LEAD = 32
PARTS = "doc_id long, text string, part int, guest boolean, sort_id long"
RADIUS, STRIDE = 3, 100
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_parts(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """Rows of (doc_id, text) dealt to ranges of doc_id (`part`), with the first row of the next range as guest of each.

    The driver holds one boundary and one smallest id a range; ranges are per_task times the shuffle's partitions.
    An id that more rows share than two ranges hold, as null ids may, is cut by the beginnings of its texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", id_key().alias("sort_id"))
    wanted = shuffle_width(spark) * per_task
    ids = rows.select("sort_id")
    marks = ids.stat.approxQuantile("sort_id", [k / wanted for k in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    bounds = sorted({(int(m), "") for m in marks})
    lead = F.substring(F.coalesce("text", F.lit("")), 1, LEAD).alias("lead")
    if len(bounds) < len(marks):  # ids that are several quantiles are shared by many rows
        bounds = sorted({*bounds, *_leads(rows.select("sort_id", lead), [m for m, times in Counter(map(int, marks)).items() if times > 1], marks)})
    rows = rows.withColumn("lead", lead).withColumn("part", _part_of(bounds)).drop("lead")
    firsts = rows.groupBy("part").agg(F.min("sort_id").alias("first_id")).collect()
    order = sorted((r["part"], r["first_id"]) for r in firsts)
    # a part's guest is the first row of the part after it; the last part's is the first row of all
    hosts = [(first, part, order[i - 1][0]) for i, (part, first) in enumerate(order)]
    guests = spark.createDataFrame(hosts, "sort_id long, part int, host int")
    lowest = rows.join(F.broadcast(guests), ["sort_id", "part"]).groupBy("sort_id", "host").agg(F.min_by(F.struct("doc_id", "text"), F.coalesce("text", F.lit(""))).alias("row"))
    visiting = lowest.select("row.doc_id", "row.text", F.col("host").alias("part"), F.lit(True).alias("guest"), "sort_id")
    return rows.select("doc_id", "text", "part", F.lit(False).alias("guest"), "sort_id").unionByName(visiting)


def _leads(rows: DataFrame, shared: list[int], marks: list[float]) -> list[tuple[int, str]]:
    """For each shared id as many beginnings of its texts as it is quantiles, from about 32 sampled rows each."""
    times = Counter(map(int, marks))
    own = rows.where(F.col("sort_id").isin(shared))
    counts = {r["sort_id"]: r["n"] for r in own.groupBy("sort_id").agg(F.count("*").alias("n")).collect()}  # a row a shared id
    share = min(1.0, 32 * max(times[i] / n for i, n in counts.items()))
    sample: dict[int, list[str]] = {}
    for r in own.where(F.rand(5) < share).select("sort_id", "lead").collect():
        sample.setdefault(r["sort_id"], []).append(r["lead"])
    out = []
    for number, leads in sample.items():
        leads.sort(key=str.encode)  # as Spark compares strings
        out += [(number, leads[len(leads) * k // times[number]]) for k in range(1, times[number])]
    return out


def _part_of(bounds: list[tuple[int, str]]) -> Column:
    """The number of bounds at or below (sort_id, lead): nested conditions of logarithmic depth, or bisection where they are many."""
    if len(bounds) > 4096:
        marks, leads = [b[0] for b in bounds], [(i, t.encode()) for i, t in bounds]
        plain = not any(t for _, t in bounds)

        @F.pandas_udf("int")
        def bisected(ids: pd.Series, lead: pd.Series) -> pd.Series:
            if plain:
                return pd.Series(np.searchsorted(np.array(marks, dtype=np.int64), ids.to_numpy(), side="right").astype(np.int32))
            return pd.Series([bisect_right(leads, (i, t.encode())) for i, t in zip(ids.tolist(), lead)], dtype="int32")

        return bisected("sort_id", "lead")

    def build(a: int, b: int) -> str:
        if a == b:
            return str(a)
        m = (a + b) // 2
        number, lead = bounds[m]
        at = f"cast('{number}' as bigint)"
        above = f"sort_id >= {at}" if not lead else f"sort_id > {at} or sort_id = {at} and lead >= cast(X'{lead.encode().hex()}' as string)"
        return f"if({above}, {build(m + 1, b)}, {build(a, m)})"

    return F.expr(build(0, len(bounds))).cast("int")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """First digit (from 1) and number of hex digits of each of radius + 1 blocks."""
    edges = np.linspace(0, BITS // 4, radius + 2).astype(int).tolist()
    return [(a + 1, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _tables(prints: DataFrame, radius: int, prefix: str) -> DataFrame:
    """Each distinct fingerprint once in each table, keyed by the block that the table brings to the front."""
    lanes = [F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"{prefix}{k}") for k in range(BITS // 64)]
    blocks = F.array(*[F.substring("fingerprint", a, n) for a, n in _blocks(radius)])
    rows = prints.select("fingerprint").distinct().select(F.col("fingerprint").alias(f"{prefix}fp"), *lanes, blocks.alias(f"{prefix}blocks"))
    return rows.select("*", F.posexplode(f"{prefix}blocks").alias("table", "key"))


def near_prints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q_fp, p_fp, distance: every distinct fingerprint of prints within the radius of one of queries.

    A pair that several tables bring together counts in the first of them only. Hot keys are left to
    the join's skew handling: each row of prints meets the queries of its key, and no other print.
    """
    q, p = _tables(queries, radius, "q_"), _tables(prints, radius, "p_")
    distance = F.lit(0)
    for k in range(BITS // 64):
        distance = distance + F.bit_count(F.col(f"q_{k}").bitwiseXOR(F.col(f"p_{k}")))
    first = F.lit(True)
    for t in range(radius):
        first = first & ((q["table"] <= t) | (F.col("q_blocks")[t] != F.col("p_blocks")[t]))
    met = p.join(q, (q["table"] == p["table"]) & (q["key"] == p["key"]) & first & (distance <= radius))
    return met.select("q_fp", "p_fp", distance.alias("distance"))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query_id, doc_id, distance of all pairs of a query and another row within the radius; both hold doc_id and fingerprint (hex)."""
    near = near_prints(queries, prints, radius)
    asked = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q_fp"))
    found = near.join(asked, "q_fp").join(prints.select("doc_id", F.col("fingerprint").alias("p_fp")), "p_fp")
    return found.where("query_id <> doc_id").select("query_id", "doc_id", "distance")


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint of each query and the number of rows of prints within the radius of it, its own rows included."""
    rows = prints.groupBy(F.col("fingerprint").alias("p_fp")).agg(F.count("*").alias("n"))
    return near_prints(queries, prints, radius).join(rows, "p_fp").groupBy(F.col("q_fp").alias("fingerprint")).agg(F.sum("n").alias("n_within"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    For every doc_id divisible by STRIDE, n_near is the number of other documents within RADIUS bits, found through the block tables.
    """
    rows = cut(edited_fingerprints(documents(spark, sf_dir)), "fingerprints")
    asked = rows.where(F.col("doc_id") % STRIDE == 0)
    counts = near_counts(rows.select("fingerprint"), asked.select("fingerprint"))
    near = F.when(F.col("doc_id") % STRIDE == 0, F.col("n_within") - 1)
    return rows.join(counts, "fingerprint", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", near.alias("n_near"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Of every row: its own and its edited text's fingerprint, and how alike they and the next document's are."""
    spark = docs.sparkSession
    ship(spark)
    parts = with_parts(docs)
    dealt = parts.repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "guest", "sort_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, int, bool]] = []
        size = 0

        def answer(rows: list[tuple[int | None, str, int, bool]]) -> pa.RecordBatch:
            """Results of all rows but the last, which is only the next document of the one before it."""
            texts = [r[1] for r in rows]
            own = [i for i in range(len(rows) - 1) if not rows[i][3]]
            edited = [_edit(texts[i], texts[i + 1]) for i in own]
            prints = fingerprints([t.encode() for t in texts])
            changed_bytes = [t.encode() for t in edited]
            changed = fingerprints(changed_bytes) if own else np.zeros((0, BITS // 8), np.uint8)
            at = np.array(own, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed_bytes], pa.string()),
                    pa.array([prints[i].tobytes().hex() for i in own], pa.string()),
                    pa.array([c.tobytes().hex() for c in changed], pa.string()),
                    pa.array(likeness(prints[at], changed)),
                    pa.array(likeness(prints[at], prints[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for doc_id, text, part, guest in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append((doc_id, text or "", part, guest))
                size += len(held[-1][1])
                if size > STEP_BYTES // 2 and len(held) > 1:
                    yield answer(held)
                    held = held[-1:]
                    size = len(held[0][1])
        if len(held) > 1:
            yield answer(held)

    return dealt.select("doc_id", "text", "part", "guest").mapInArrow(run, RESULT)
