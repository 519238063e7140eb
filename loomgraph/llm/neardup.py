"""Operator 6: SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are the points. A vantage-point tree, fitted on a bounded sample, cuts the
Hamming space to shards: at each node a point lies inside (distance to the vantage point at most the
node's radius) or outside. Two points within r of one another have distances to any vantage point
that differ by r at most, so a point also visits, as a guest, those shards that such a neighbour may
call home, and no others. Each shard joins its points with themselves and its guests by the same
recursion, pruned by the same bounds, and gives one link from each point to its group's root in the
shard; alternating large-star and small-star steps then unite the shards' groups.

Work follows distinct fingerprints and links of a spanning forest, never all pairs of a group: copies
are one point, and point sets known to be connected are not compared again.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated
rows share their component; component_id is the smallest doc_id (null doc_ids are larger than any,
and a component of null doc_ids alone has a null id); a text of any length is read whole, by one task; an empty
table gives no row; other columns are never looked at. `keep_first` takes rows that are equal in all columns that have a
hash (maps and variants have none) as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, free_name, steps, texts_of
from loomgraph.llm.components import components
from loomgraph.llm.hashing import mix64
from loomgraph.llm.resemblance import SHINGLE as FIVE
from loomgraph.llm.resemblance import alike_components
from loomgraph.llm.simhash import column_sums
from loomgraph.session import cut, ship

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Points that a shard calls its own, about, and points that the driver samples for each shard.
SHARD_POINTS, SAMPLE_POINTS, MOST_SHARDS = 4096, 48, 1 << 16
#: Guests that a task joins with a shard's own points, about: a shard with more is joined by several tasks.
MOST_GUESTS = 1 << 22
#: Pairs that are compared at once.
CHUNK = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    joined = b" ".join(text.encode().lower().split())  # bytes: only A-Z change case, only the six blanks split
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    if len(starts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * column_sums(bits) > len(hashes)).tobytes(), "big")


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a (signed) long of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- vantage-point trees


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int, float]:
    """A vantage point, its radius, and the share of points that would lie on both sides: of some tries, the least, of even cuts first."""
    best = None
    for vantage in points[rng.integers(0, len(points), tries)]:
        counts = np.bincount(distances(points, vantage), minlength=66)
        below = np.cumsum(counts)
        for mu in np.flatnonzero(counts[:-1]):
            inner = below[mu]
            if not 0 < inner < len(points):
                continue
            balance = min(inner, len(points) - inner) / len(points)
            both = (below[min(mu + radius, 65)] - (below[mu - radius] if mu >= radius else 0)) / len(points)
            cost = both + 4 * max(0.0, 0.3 - balance)
            if best is None or cost < best[0]:
                best = cost, vantage, int(mu), both
    return (points[0], 64, 1.0) if best is None else best[1:]


class Tree:
    """A complete tree of `depth` levels in heap order; leaf k is node 2 ** depth - 1 + k."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int) -> None:
        self.depth, self.radius = depth, radius
        self.vantage, self.mu = np.zeros((1 << depth) - 1, dtype=np.uint64), np.full((1 << depth) - 1, 64, dtype=np.int16)
        rng, held = np.random.default_rng(1), {0: sample}
        for node in range((1 << depth) - 1):
            own = held.pop(node)
            if len(own) > 1:
                self.vantage[node], self.mu[node], _ = choose(own, radius, rng)
            inside = distances(own, self.vantage[node]) <= self.mu[node]
            held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's home leaf, and the pairs (number of a point, leaf) of its visits to later leaves."""
        home = np.zeros(len(points), dtype=np.int64)
        which, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            d = distances(points, self.vantage[home])
            home = 2 * home + 1 + (d > self.mu[home])
            d, mu = distances(points[which], self.vantage[node]), self.mu[node]
            near, far = d <= mu + self.radius, d > mu - self.radius
            which, node = np.concatenate([which[near], which[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        first = (1 << self.depth) - 1
        guest = node > home[which]
        return home - first, which[guest], node[guest] - first


class Groups:
    """Union-find over arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                self.parent[x] = root
                return root
            root = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def one(self, *sets: np.ndarray) -> bool:
        """Whether all members of the sets are known to be connected."""
        roots = self.find(np.concatenate(sets))
        return bool((roots == roots[0]).all())


class Join:
    """Unites all points of a shard within the radius: its own with each other, and with its guests."""

    def __init__(self, points: np.ndarray, n_own: int, radius: int, within: bool = True) -> None:
        self.points, self.radius, self.groups, self.rng = points, radius, Groups(len(points)), np.random.default_rng(2)
        own, guests = np.arange(n_own), np.arange(n_own, len(points))
        if within:
            self.within(own)
        if len(own) and len(guests):
            self.across(own, guests)

    def _chunks(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares all of a with all of b, a few rows at a time."""
        rows = max(1, CHUNK // len(b))
        for k in range(0, len(a), rows):
            part = a[k : k + rows]
            if self.groups.one(part, b):
                continue
            i, j = np.nonzero(np.bitwise_count(self.points[part][:, None] ^ self.points[b][None, :]) <= self.radius)
            self.groups.unite(part[i], b[j])

    def within(self, own: np.ndarray) -> None:
        if len(own) < 2 or self.groups.one(own):
            return
        if len(own) <= 512:
            self._chunks(own, own)
            return
        vantage, mu, both = choose(self.points[own[self.rng.integers(0, len(own), 256)]] if len(own) > 1024 else self.points[own], self.radius, self.rng)
        d = distances(self.points[own], vantage)
        close = own[2 * d <= self.radius]  # all of these are within the radius of one another
        if len(close) > 1:
            self.groups.unite(close[1:], np.full(len(close) - 1, close[0]))
        inside = d <= mu
        if both > 0.9 or inside.all() or not inside.any():
            self._chunks(own, own)
            return
        self.within(own[inside])
        self.within(own[~inside])
        self.across(own[inside & (d > mu - self.radius)], own[~inside & (d <= mu + self.radius)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b) or self.groups.one(a, b):
            return
        if len(a) * len(b) <= CHUNK // 4:
            self._chunks(a, b)
            return
        large = a if len(a) > len(b) else b
        vantage, mu, both = choose(self.points[large[self.rng.integers(0, len(large), 256)]], self.radius, self.rng)
        da, db = distances(self.points[a], vantage), distances(self.points[b], vantage)
        inside = da <= mu
        if both > 0.9 or inside.all() and (db <= mu + self.radius).all() or not inside.any() and (db > mu - self.radius).all():
            self._chunks(a, b)
            return
        self.across(a[inside], b[db <= mu + self.radius])
        self.across(a[~inside], b[db > mu - self.radius])


def shard_links(own: np.ndarray, guests: np.ndarray, radius: int, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) for every point of a shard that has company; without `within`, own points meet guests only."""
    points = np.concatenate([own, guests])
    if not len(own) or len(points) < 2:
        return points[:0], points[:0]
    groups = Join(points, len(own), radius, within).groups
    root = groups.find(np.arange(len(points)))
    linked = root != np.arange(len(points))
    return points[linked], points[root[linked]]


# ---------------------------------------------------------------- the distributed join


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (u, v) of the graph that links distinct longs `fp` of at most `radius` differing bits."""
    spark = points.sparkSession
    ship(spark)
    n = points.count()
    depth = min(max(0, int(np.ceil(np.log2(max(1, n / SHARD_POINTS))))), MOST_SHARDS.bit_length() - 1)
    wanted = min(n, (1 << depth) * SAMPLE_POINTS)
    # the sample only shapes the tree: at most MOST_SHARDS * SAMPLE_POINTS longs
    sample = points.select("fp").orderBy(F.xxhash64("fp")).limit(wanted) if wanted else points.select("fp").limit(0)
    sampled = np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64)
    built = Tree(sampled, depth, radius)
    guests_of_a_shard = len(built.route(sampled[:4096])[1]) / max(1, min(4096, len(sampled))) * n / (1 << depth)
    parts = max(1, int(np.ceil(guests_of_a_shard / MOST_GUESTS)))
    tree = spark.sparkContext.broadcast(built)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            home, which, leaf = tree.value.route(own)
            # a shard's own points go to all of its tasks, a guest to one
            part = (mix64(own[which]) % np.uint64(parts)).astype(np.int64)
            to = np.concatenate([*(home * parts + k for k in range(parts)), leaf * parts + part])
            who = np.concatenate([*[np.arange(len(own))] * parts, which])
            guest = np.arange(len(to)) >= len(own) * parts
            order = np.lexsort((guest, to))
            to, who, guest = to[order], own[who[order]], guest[order]
            edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, dtype=int)
            middle = np.concatenate([[0], np.cumsum(~guest)])
            cuts = [(a, a + middle[b] - middle[a], b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]], pa.int64()), pa.array([who[a:m].tobytes() for a, m, _ in cuts], pa.binary()), pa.array([who[m:b].tobytes() for _, m, b in cuts], pa.binary())], ["task", "own", "guests"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        own, guests = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint64) for c in ("own", "guests"))
        u, v = shard_links(own, guests, radius, int(pdf["task"].iloc[0]) % parts == 0)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    shards = points.select("fp").mapInArrow(route, "task long, own binary, guests binary")
    return shards.groupBy("task").applyInPandas(join, "u long, v long")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = cut(fingerprint_documents(docs, shingle), "fingerprints")
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points, radius))
    rooted = points.join(roots, points["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """A never-null name of a row: rows of one name are equal in all columns, so any of them may stand for the others."""
    compared = [F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]  # these have no hash
    parts = [F.col("doc_id").cast("string"), F.md5("text"), F.xxhash64(*compared).cast("string")]
    return F.concat_ws("|", *[F.coalesce(part, F.lit("-")) for part in parts])


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents' own columns, of each component of `resemblance` one row; the trees find candidates, beside its bands.

    That of the smallest doc_id stays, null ids last, then of the least key (id, hash of the text, hash of all
    columns); rows that are equal in all columns are one. Rows without doc_id, and different texts under one doc_id,
    are each of their own component unless they resemble another text.
    """
    key = free_name(docs, "_kept")
    keyed = docs.withColumn(key, row_key(docs))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key))
    alike = alike_components(keyed, key, partial(fingerprint, shingle=FIVE), lambda points: components(links(cut(points, "points"))))
    found = alike.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first")[key].alias(key))
    repeated = alike.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key).join(found, key, "left_semi")
    own = [f"`{c}`" for c in docs.columns]
    # a hash table of keys, so that texts aren't sorted; of the kept rows only those that repeat are
    if repeated.isEmpty():
        return keyed.join(found.hint("shuffle_hash"), key).select(*own)
    repeated = cut(repeated, "repeated")
    single = found.join(repeated, key, "left_anti")
    return keyed.join(single.hint("shuffle_hash"), key).unionByName(keyed.join(repeated.hint("shuffle_hash"), key).dropDuplicates([key])).select(*own)
