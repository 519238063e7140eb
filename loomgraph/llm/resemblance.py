"""Components of texts that share at least 0.8 of their five-word shingles.

The resemblance of two texts is the Jaccard index of their sets of SHINGLE-word shingles (a shorter text
is one shingle); a component joins texts that a chain of pairs of LEAST or more connects. Texts of
one set are one point. MinHash values in BANDS bands of ROWS find candidates: a pair of 0.8 shares no band
with a probability of 0.00007, and one of more less often. Components of near fingerprints (op6's vantage-point trees) are
one band more. Points that share bands, directly or by others, are
a cluster, and there the sets themselves are compared, so that nothing below LEAST links.

A cluster of up to MOST_SHINGLES shingles is compared by one task. A larger one is dealt out to blocks of that size,
each with the cluster's first point: each block links its own points. Only bands whose points are still of several
components after that are compared again, in pairs of blocks (a pair of 0.8 that shares
no band, 0.00007 of them, may so be found in a small cluster and not in a large one). So no task holds more than two blocks and a
point, however large a group of copies is, and no pair that shares a band is left out.

Words are those of `common`, with A-Z as a-z. Null, empty and blank texts are one point. Points are named
by 64-bit hashes of their sets; rows that repeat are one point; texts of any length are read whole;
an empty table has no component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import _TO_SPACE_LOWER, steps, texts_of
from loomgraph.llm.components import components
from loomgraph.llm.hashing import Rolling, mix64, word_spans
from loomgraph.session import cut, ship

SHINGLE = 5
#: The least resemblance that links, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
#: Shingles of the points that a task compares, about.
MOST_SHINGLES = 1 << 20

_BLANK = np.arange(256) == 32
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_XORS, _FACTORS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_FACTORS = _FACTORS | np.uint64(1)
_ROLLING: list[Rolling] = []


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text without words has the one hash zero."""
    if not _ROLLING:
        _ROLLING.append(Rolling(11))
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" ".join(encoded) + b" ").translate(_TO_SPACE_LOWER), dtype=np.uint8)
    starts, ends = word_spans(data, _BLANK)
    words = _ROLLING[0].ranges(_ROLLING[0].prefix(data), starts, ends)
    edges = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in encoded]))])
    runs = words.copy()
    for k in range(1, size):
        runs = mix64(runs[:-1] * _NEXT + words[k:]) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            one = words[a : a + 1]
            for k in range(a + 1, b):
                one = mix64(one * _NEXT + words[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(1, dtype=np.uint64))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS hashes a set; sets that are alike share some of them."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix64(key * _NEXT + np.minimum.reduceat((flat ^ _XORS[k]) * _FACTORS[k], at))
        out[:, band] = key
    return out


def groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that a chain of resemblances of LEAST or more connects it with."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, dtype=bool)
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    root = np.full(len(sets), -1)
    live, flat = np.arange(len(sets)), codes
    at = np.cumsum(sizes) - sizes
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            i = queue.pop()
            left = live[root[live] < 0]
            if not len(left):
                break
            if 2 * len(left) <= len(live):  # only the unreached are compared, so their codes are drawn together now and then
                live, flat = left, np.concatenate([parts[j] for j in left])
                at = np.cumsum(sizes[live]) - sizes[live]
            mark[parts[i]] = True
            both = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[parts[i]] = False
            near = live[(LEAST[1] * both >= LEAST[0] * (sizes[i] + sizes[live] - both)) & (root[live] < 0)]
            root[near] = seed
            queue += near.tolist()
    return root


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """(point, root) links of the points of one task; a point may be there twice, as the head of a cluster is."""
    pdf = pdf.drop_duplicates("point")
    points = pdf["point"].to_numpy()
    root = groups([np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]])
    moved = root != np.arange(len(root))
    return pd.DataFrame({"point": points[moved], "root": points[root[moved]]})


def links(banded: DataFrame, sets: DataFrame, most: int | None = None) -> DataFrame:
    """(point, root) links that connect all points of sets (cluster, point, n, shingles) that share a band (point, band) and are alike."""
    most = most or MOST_SHINGLES
    out = "point long, root long"
    blocks = lambda size, part=most: F.ceil(F.col(size) / F.lit(part)).cast("int")
    sizes = sets.groupBy("cluster").agg(F.sum("n").alias("size"), F.min("point").alias("head"))
    large = sizes.where(F.col("size") > most)
    dealt = sets.join(sizes.select("cluster", "size"), "cluster").select("cluster", F.pmod(F.xxhash64("point"), blocks("size")).cast("int").alias("block"), "point", "shingles")
    heads = large.select("cluster", F.col("head").alias("point"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("block"))
    with_heads = heads.join(sets.select("cluster", "point", "shingles"), ["cluster", "point"]).select(*dealt.columns)
    first = dealt.unionByName(with_heads).groupBy("cluster", "block").applyInPandas(compare, out)
    if large.isEmpty():
        return first
    first = cut(first, "alike")
    found = components(first.select(F.col("point").alias("u"), F.col("root").alias("v")))
    members = sets.join(large.select("cluster"), "cluster", "left_semi").select("point", "n").join(found.select(F.col("u").alias("point"), "root"), "point", "left").select("point", "n", F.coalesce("root", "point").alias("family"))
    grouped = banded.join(members, "point")
    contested = grouped.groupBy("band").agg(F.min("family").alias("least"), F.max("family").alias("largest"), F.sum("n").alias("size")).where("least < largest")
    blocked = grouped.join(contested.select("band", blocks("size").alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("point", "band"), F.col("blocks")).cast("int"))
    paired = blocked.select("band", "point", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    tasks = paired.select("band", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "point").distinct()
    second = tasks.join(sets.select("point", "shingles"), "point").groupBy("band", "a", "b").applyInPandas(compare, out)
    united = components(first.unionByName(second).select(F.col("point").alias("u"), F.col("root").alias("v")))
    return united.select(F.col("u").alias("point"), "root")


def alike_components(docs: DataFrame, key: str, prints: Callable[[str], int], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, the key and the root of every row; rows of one key (a string) are to have one text.

    prints gives a text's fingerprint, near the (u, root) components of a table of distinct ones (fp): points of one
    such component are candidates as those of one band are.
    """
    ship(docs.sparkSession)
    names = [f"band_{k}" for k in range(BANDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(texts_of(batch))
            points = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            banded = [pa.array(np.ascontiguousarray(column)) for column in bands(sets).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(points), pa.array(np.array([prints(t) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)), *banded], ["doc_id", "row", "point", "fp", *names])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "point", "n", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("row"))
    rows = cut(own.mapInArrow(sketch, f"doc_id long, row string, point long, fp long, {', '.join(f'{n} long' for n in names)}"), "sketches")
    # rows of one point have the same bands
    banded = rows.groupBy("point").agg(*[F.min(n).alias(n) for n in names]).select("point", F.explode(F.array(*names)).alias("band"))
    # and the fingerprints that lie near each other, directly or by others, are a band too
    printed = rows.groupBy("point").agg(F.min("fp").alias("fp"))
    rooted = printed.join(near(printed.select("fp").distinct()), F.col("fp") == F.col("u"), "left").select("point", F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("band"))
    banded = cut(banded.unionByName(rooted), "bands")
    shared = banded.groupBy("band").agg(F.min("point").alias("least"), F.max("point").alias("most")).where("least < most")
    candidates = banded.join(shared, "band").where("point <> least").select(F.col("point").alias("u"), F.col("least").alias("v"))
    reached = components(candidates)
    clusters = reached.select(F.col("u").alias("point"), F.col("root").alias("cluster")).unionByName(reached.select(F.col("root").alias("point"), F.col("root").alias("cluster")).distinct())
    shown = rows.groupBy("point").agg(F.min("row").alias("row")).join(clusters, "point")  # one row shows a point's text
    texts = own.select("text", "row").join(shown.hint("shuffle_hash"), "row").dropDuplicates(["row"]).select("cluster", "point", "text")
    sets = cut(texts.mapInArrow(shingles, "cluster long, point long, n long, shingles binary"), "shingles")
    linked = cut(links(banded, sets), "alike")
    return rows.join(linked, "point", "left").select("doc_id", F.col("row").alias(key), F.coalesce("root", "point").alias("root"))
