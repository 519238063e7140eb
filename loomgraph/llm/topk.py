"""Operator 10: exact top-k search by inner product through a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. The inner product becomes a
distance by one more coordinate, sqrt(M - |x|^2) with M the largest squared length (0 for queries):
then |q - x|^2 = |q|^2 + M - 2 q.x, and the triangle inequality bounds scores. A query first looks at
the pivots and at the cell that it lies in, which give it a k-th best score to beat; it then visits only the cells
whose ring of distances may hold a better one, and in each expands annuli outwards from its own
distance to the pivot until the bound falls below its k-th best. Queries of a cell go through its annuli in
blocks, so that a block's scores with an annulus are one matrix product.

Cells are split to pieces of bounded size, so a pivot that attracts a third of all vectors, or one
vector that is a third of all, is shared out. A task holds a piece and the queries of one group
(QUERY_GROUP), whatever the number of queries; vectors travel in the narrowest integers that hold them.

The bound prunes as far as the vectors allow. Unrelated directions in many dimensions lie at nearly the
same distance from every pivot, and then nearly every ring is open: work grows with queries x vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with
a null vec_id, take no part; nor do vectors whose scaled squared length reaches 2^62, as their scores wouldn't fit in 64
bits (those of the others do, by Cauchy and Schwarz); an empty table gives no row; shorter vectors are taken as ending in zeros; rows that repeat a vec_id
are candidates each, but not for that id's query, which is asked once (with the least of its
vectors); equal scores go to the smaller vec_id; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.hashing import mix64
from loomgraph.session import cut, ship

K, SCALE = 20, 64
#: Vectors of a piece of a cell, pivots at most (one for each CELL_ROWS vectors, and half the root of their number at least), and the query's stride.
CELL_ROWS, MOST_PIVOTS, STRIDE = 4096, 4096, 20
#: Vectors that one annulus adds, queries of a block, and of a group that meets a piece.
ANNULUS, BLOCK, QUERY_GROUP = 512, 256, 8192
#: Relative slack of bounds that are computed in floating point.
SLACK = 1e-9
#: Below any score.
NOTHING = -(2**62)


def unpack(blobs: list[bytes], dim: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, dim)


def scores(queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products of rows: in floating point where its integers suffice. largest: the highest product that may come."""
    if largest < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


class Top:
    """The k best so far of a block of queries, and the score that each must beat or equal."""

    def __init__(self, beat: np.ndarray, k: int) -> None:
        self.beat, self.k = beat.astype(np.int64).copy(), k
        self.query, self.ids, self.got = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, got: np.ndarray) -> None:
        query, ids, got = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.got, got])
        order = np.lexsort((ids, -got, query))
        query, ids, got = query[order], ids[order], got[order]
        begin = np.searchsorted(query, query)
        rank = np.arange(len(query)) - begin
        keep = rank < self.k
        full = rank == self.k - 1
        self.beat[query[full]] = np.maximum(self.beat[query[full]], got[full])
        self.query, self.ids, self.got = query[keep], ids[keep], got[keep]


class Cell:
    """One piece of a cell: its vectors in ascending distance to the pivot. largest: M; reach: the highest product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, to_pivot: np.ndarray, largest: float, reach: float, annulus: int = ANNULUS) -> None:
        order = np.argsort(to_pivot, kind="stable")
        self.ids, self.vectors, self.to_pivot, self.largest, self.reach, self.annulus = ids[order], vectors[order], to_pivot[order], largest, reach, annulus
        if reach < 2**53:
            self.vectors = self.vectors.astype(np.float64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, distance: np.ndarray, beat: np.ndarray, k: int) -> Top:
        """This piece's k best of at least `beat` for a block of queries, expanding annuli around the queries' distances to the pivot."""
        top, n = Top(beat, k), len(self.ids)
        if self.reach < 2**53:
            queries = queries.astype(np.float64)
        length = (queries.astype(np.float64) ** 2).sum(axis=1) + self.largest
        low = high = int(np.searchsorted(self.to_pivot, np.median(distance))) if len(distance) else 0
        while low > 0 or high < n:
            # the nearer side first; no vector that is left on a side is nearer to a query than that side's edge
            down = distance.min() - self.to_pivot[low - 1] if low > 0 else np.inf
            up = self.to_pivot[high] - distance.max() if high < n else np.inf
            a, b = (max(0, low - self.annulus), low) if down <= up else (high, min(n, high + self.annulus))
            low, high = (a, high) if down <= up else (low, b)
            near, far = self.to_pivot[a], self.to_pivot[b - 1]
            apart = np.maximum(0.0, np.maximum(near - distance, distance - far))
            asked = np.flatnonzero((length - apart * apart) / 2 + SLACK * (length + 1) >= top.beat)
            if len(asked):
                part = scores(queries[asked], self.vectors[a:b], self.reach)
                row, col = np.nonzero((part >= top.beat[asked][:, None]) & (query_ids[asked][:, None] != self.ids[a:b][None, :]))
                if len(row):
                    top.add(asked[row], self.ids[a:b][col], part[row, col])
            else:
                rest = np.maximum(0.0, distance - far if down <= up else near - distance)
                if ((length - rest * rest) / 2 + SLACK * (length + 1) < top.beat).all():  # and what lies beyond is farther still
                    low, high = (0, high) if down <= up else (low, n)
        return top


def quantised(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) of every component, rows that take no part left out."""
    usable = F.expr(f"size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(usable)
    rows = rows.where(F.expr(f"aggregate({column}, 0D, (s, x) -> s + pow(floor({scale} * cast(x as double)), 2)) < {2.0**62!r}"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform({column}, x -> floor({scale} * cast(x as double)))").alias("vector"))


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, stride: int = STRIDE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by stride."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, scale)
    length = F.expr("aggregate(vector, 0D, (s, x) -> s + cast(x as double) * x)")
    shape = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % stride == 0).alias("asked"), F.max(F.size("vector")).alias("dim"), F.max(length).alias("largest"), F.max(F.expr("array_max(transform(vector, x -> abs(x)))")).alias("component")).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], out_schema)
    dim, largest, component = int(shape["dim"]), float(shape["largest"]), int(shape["component"])
    kind = next(f"<i{b}" for b in (1, 2, 4, 8) if component < 2 ** (8 * b - 1) or b == 8)
    reach, annulus, block = min(float(component) ** 2 * dim, largest), ANNULUS, BLOCK
    n_pivots = int(np.clip(max(shape["n"] // CELL_ROWS, math.isqrt(shape["n"]) // 2), 1, MOST_PIVOTS))
    groups = max(1, -(-shape["asked"] // QUERY_GROUP))
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(max(n_pivots, k + 1)).collect()  # MOST_PIVOTS vectors, or a few more than k
    sample_ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
    sampled = np.array([list(r["vector"]) + [0] * (dim - len(r["vector"])) for r in sample], dtype=np.int64)
    pivots = sampled[:n_pivots].astype(np.float64)
    lift = lambda x: np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=-1)))
    raised = np.column_stack([pivots, lift(pivots)])
    shared = spark.sparkContext.broadcast(raised)
    seen = spark.sparkContext.broadcast((sample_ids, sampled))

    def distances(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        full, at = np.column_stack([x, extra]), shared.value
        square = (full * full).sum(axis=1)[:, None] + (at * at).sum(axis=1)[None, :] - 2 * full @ at.T
        return np.sqrt(np.maximum(0.0, square))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                x = np.zeros((batch.num_rows, dim), dtype=np.int64)
                x[np.arange(dim)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
                real = x.astype(np.float64)
                d = distances(real, np.sqrt(np.maximum(0.0, largest - (real * real).sum(axis=1))))
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(x)), pivot])], ["vec_id", "vector", "pivot", "distance"])

    index = cut(rows.mapInArrow(assign, "vec_id long, vector binary, pivot int, distance double"), "pivots")
    rings = index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()  # a row a pivot
    pieces = {r["pivot"]: -(-r["n"] // CELL_ROWS) for r in rings}
    base, total = {}, 0
    for pivot in sorted(pieces):
        base[pivot], total = total, total + pieces[pivot]
    named = spark.createDataFrame([(p, base[p], pieces[p]) for p in sorted(pieces)], "pivot int, base int, pieces int")
    celled = index.join(F.broadcast(named), "pivot").select("vec_id", "vector", "distance", (F.col("base") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("pieces"))).cast("int").alias("cell"))

    def own_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        """A score that each query's k-th best can't be below: its k-th best among the pivots, and in the piece it lies in."""
        ids, x, d = pdf["vec_id"].to_numpy(), unpack(pdf["vector"].tolist(), dim, kind), pdf["distance"].to_numpy()
        cell = Cell(ids, x, d, largest, reach, annulus)
        asked, marks = np.flatnonzero(ids % stride == 0), []
        asked = asked[np.argsort(d[asked], kind="stable")]
        for start in range(0, len(asked), block):
            some = asked[start : start + block]
            others = np.where(seen.value[0][None, :] != ids[some][:, None], scores(x[some], seen.value[1], reach), NOTHING)
            mark = np.partition(others, others.shape[1] - k, axis=1)[:, others.shape[1] - k] if others.shape[1] >= k else np.full(len(some), NOTHING)
            marks.append(cell.search(ids[some], x[some], d[some], mark, k).beat)
        return pd.DataFrame({"query_id": ids[asked], "query": pdf["vector"].to_numpy()[asked], "beat": np.concatenate([np.zeros(0, np.int64), *marks])})

    queries = celled.groupBy("cell").applyInPandas(own_cell, "query_id long, query binary, beat long")
    queries = cut(queries.groupBy("query_id").agg(F.min(F.struct("query", "beat")).alias("q")).select("query_id", "q.query", "q.beat"), "queries")
    ring = np.array([[r["pivot"], r["low"], r["high"]] for r in sorted(rings, key=lambda r: r["pivot"])])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs, for each piece, the queries whose bound lets them find something there."""
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                ids, x, beat = batch.column(0).to_numpy(), unpack(batch.column(1).to_pylist(), dim, kind), batch.column(2).to_numpy()
                group = (mix64(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                real = x.astype(np.float64)
                d = distances(real, np.zeros(len(x)))[:, ring[:, 0].astype(int)]
                nearest = np.maximum(0.0, np.maximum(d - ring[:, 2], ring[:, 1] - d))
                length = (real * real).sum(axis=1)[:, None] + largest
                open_ = (length - nearest**2) / 2 + SLACK * (length + 1) >= beat[:, None]
                for j in np.flatnonzero(open_.any(axis=0)).tolist():
                    own = np.flatnonzero(open_[:, j])
                    own = own[np.lexsort((d[own, j], group[own]))]
                    edges = [0, *(np.flatnonzero(np.diff(group[own])) + 1).tolist(), len(own)]
                    for a, b in zip(edges[:-1], edges[1:]):
                        for start in range(a, b, block):
                            some = own[start : min(b, start + block)]
                            packed = [ids[some].tobytes(), x[some].tobytes(), d[some, j].tobytes(), beat[some].tobytes()]
                            n, at = pieces[int(ring[j, 0])], base[int(ring[j, 0])]
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int32()), pa.array([int(group[own[a]])] * n, pa.int32()), *(pa.array([p] * n, pa.binary()) for p in packed)], ["cell", "part", "ids", "vectors", "distances", "beats"])

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(own) and len(asked):
            cell = Cell(own["vec_id"].to_numpy(), unpack(own["vector"].tolist(), dim, kind), own["distance"].to_numpy(), largest, reach, annulus)
            for ids, x, d, beat in zip(*(asked[c] for c in ("ids", "vectors", "distances", "beats"))):
                ids = np.frombuffer(ids, np.int64)
                top = cell.search(ids, unpack([x], dim, kind), np.frombuffer(d), np.frombuffer(beat, np.int64), k)
                out.append((ids[top.query], top.ids, top.got))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "vec_id", "score"), zip(*out))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which groups of queries a piece meets at all."""
        seen_pairs: set[tuple[int, int]] = set()
        for batch in visit(batches):
            seen_pairs.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in seen_pairs], pa.int32()) for k in range(2)], ["cell", "part"])

    visits = queries.mapInArrow(visit, "cell int, part int, ids binary, vectors binary, distances binary, beats binary")
    # a piece meets each group of queries in a task of its own, and goes only where a query of the group visits it
    groups_of = queries.mapInArrow(meet, "cell int, part int").groupBy("cell").agg(F.collect_set("part").alias("parts"))
    parted = celled.join(groups_of, "cell").withColumn("part", F.explode("parts")).drop("parts")
    found = parted.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in DuckDB SQL.
OP10_SQL = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as vec from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
e as (select vec_id, unnest(vec) as x, generate_subscripts(vec, 1) as i from v),
s as (
  select q.vec_id as query_id, c.vec_id, sum(q.x * c.x) as score
  from e q join e c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, cast(score as bigint) as score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
