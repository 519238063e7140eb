"""Approximate search for similar vectors: a small-world graph in each shard, searched shard by shard and merged.

Rows are dealt out to shards at random, so no shard is hot however often a vector or a key is repeated, and every shard is
a fair sample of the whole. In a shard each vector is linked to its nearest ones, to those that have it among theirs, and
to a few at random. A query walks each shard's graph from the best of some entries, always on from the best vector that
it hasn't left yet, until none of its `beam` best is left; the shards' best are merged. Every row is in the graph: equal
vectors of a shard are one node with all their keys, so that many copies neither fill a walk nor wall off the rest.

Vectors that are null, of another length, without direction (all zero) or with components that aren't finite take no part.
Ties go to the smaller key. Keys of queries are unique; queries without a key or a vector that counts have no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut, discard, ship

#: Vectors of a shard, and queries that walk it in one task.
SHARD_ROWS, QUERY_ROWS = 8_192, 2_048
#: Links to the nearest, and as many from those at most; links at random.
DEGREE, LONG = 16, 2
#: How many of the best a walk keeps. Recall and work grow with it.
BEAM = 128
#: Rows whose exact scores are computed at once.
EXACT_ROWS = 1 << 16


def _counts(column: Column, dimensions: int) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == dimensions) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def directions(lists: pd.Series) -> np.ndarray:
    """Vectors of length one, a row each."""
    x = np.stack(lists.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths of very small and very large vectors
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def links(x: np.ndarray, degree: int = DEGREE, seed: int = 7) -> np.ndarray:
    """The links of each row of x, padded with its own place."""
    n, k = len(x), min(degree, len(x) - 1)
    own = np.arange(n)
    near = np.zeros((n, k), dtype=np.int32)
    for a in range(0, n, 512) if k else ():
        score = x[a : a + 512] @ x.T
        score[np.arange(len(score)), own[a : a + 512]] = -np.inf
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable")
        near[a : a + 512] = np.take_along_axis(best, order, axis=1)
    back = np.tile(own[:, None], (1, degree)).astype(np.int32)
    ends, starts, rank = near.ravel(), np.repeat(own, k), np.tile(np.arange(k), n)
    order = np.lexsort((starts, rank, ends))
    ends, starts = ends[order], starts[order]
    place = np.arange(len(ends)) - np.searchsorted(ends, ends)
    kept = place < degree
    back[ends[kept], place[kept]] = starts[kept]
    far = np.random.default_rng(seed).integers(0, n, (n, LONG)).astype(np.int32)
    return np.hstack([near, back, far])


def walk(x: np.ndarray, near: np.ndarray, q: np.ndarray, most: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the places of about the `most` best rows of x and their scores, best first, and how many rows were scored."""
    n, rows = len(x), np.arange(len(q))
    beam = min(max(beam, most), n)
    entries = np.unique(np.linspace(0, n - 1, min(n, max(beam // 4, int(n**0.5)))).astype(np.int64))
    seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column stands for no row
    seen[:, entries] = seen[:, n] = True
    ids = np.full((len(q), beam), n, dtype=np.int64)
    score = np.full((len(q), beam), -np.inf, dtype=np.float32)
    left = np.ones((len(q), beam), dtype=bool)
    scored = np.full(len(q), len(entries))

    def merge(at: np.ndarray, new: np.ndarray, found: np.ndarray) -> None:
        all_ids, all_score = np.hstack([ids[at], new]), np.hstack([score[at], found])
        all_left = np.hstack([left[at], np.zeros(new.shape, dtype=bool)])
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[at], score[at], left[at] = (np.take_along_axis(m, best, axis=1) for m in (all_ids, all_score, all_left))

    merge(rows, np.tile(entries, (len(q), 1)), q @ x[entries].T)
    while True:
        open_score = np.where(left | (ids == n), -np.inf, score)
        pick = open_score.argmax(axis=1)
        at = rows[open_score[rows, pick] > -np.inf]
        if not len(at):
            break
        left[at, pick[at]] = True
        new = np.sort(near[ids[at, pick[at]]].astype(np.int64), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[at[:, None], new]] = n
        seen[at[:, None], new] = True
        fresh = new < n
        scored[at] += fresh.sum(axis=1)
        found = np.full(new.shape, -np.inf, dtype=np.float32)
        r, c = np.nonzero(fresh)
        found[r, c] = np.einsum("ij,ij->i", q[at[r]], x[new[r, c]])
        merge(at, new, found)
    order = np.argsort(-score, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1), scored


def build(vectors: DataFrame, dimensions: int, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """The graph: shard, place, ids (in order, null last), vector and near (places of linked nodes in the shard), written once to shared storage."""
    ship(vectors.sparkSession)
    usable = vectors.select(F.col(key).cast("long").cast("string").alias("id"), F.col(column).cast("array<double>").alias("vector")).where(_counts(F.col("vector"), dimensions))
    shards = max(1, -(-usable.count() // shard_rows))
    dealt = cut(usable.withColumn("shard", F.floor(F.rand(seed) * shards).cast("int")), "dealt")  # written, as a row that runs again may be dealt elsewhere

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        # keys travel as text: in pandas a null would make floats of all of them
        keys: dict[bytes, list[str | None]] = {}
        for vector, key in zip(rows["vector"], rows["id"]):
            keys.setdefault(vector.tobytes(), []).append(key if isinstance(key, str) else None)
        held = sorted(((sorted(ids, key=_last_null), vector) for vector, ids in keys.items()), key=lambda node: (_last_null(node[0][0]), node[1]))
        ids, nodes = [i for i, _ in held], [np.frombuffer(v) for _, v in held]
        near = links(directions(pd.Series(nodes)), seed=seed)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "place": np.arange(len(nodes)), "ids": ids, "vector": nodes, "near": list(near)})

    graph = cut(dealt.groupBy("shard").applyInPandas(link, "shard int, place int, ids array<string>, vector array<double>, near array<int>"), "vector-graph")
    discard(dealt)
    return graph


def _last_null(key: str | None) -> tuple[bool, int]:
    return (key is None, int(key or 0))


def search(graph: DataFrame, queries: DataFrame, dimensions: int, most: int = 10, key: str = "vec_id", column: str = "embedding", beam: int = BEAM, exact: bool = False) -> DataFrame:
    """query_id, rank, id, cosine of each query's `most` best rows, and scored: how many rows were compared with the query.

    Each shard is walked by blocks of QUERY_ROWS queries or so; a block and a shard meet in one task. With exact, the
    walk's last score is the bound of a check of the shard's other rows (work grows with queries x rows), so none is missed.
    """
    ship(graph.sparkSession)
    shards = (graph.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("query")).where(F.col("query_id").isNotNull() & _counts(F.col("query"), dimensions))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_found(rows, wanted, most, beam, exact), ignore_index=True) if len(rows) and len(wanted) else _none()

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(lambda wanted, rows: meet(rows, wanted), "query_id long, id long, cosine double, scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc_nulls_last("id"))
    # a query's rows are `most` a shard; the count of scored rows is on one of them
    ranked = found.withColumn("rank", F.row_number().over(best)).withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= most).select("query_id", "rank", "id", "cosine", "scored")


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series(dtype="Int64"), "id": pd.Series(dtype="Int64"), "cosine": pd.Series(dtype=float), "scored": pd.Series(dtype="int64")})


def _found(rows: pd.DataFrame, wanted: pd.DataFrame, most: int, beam: int, whole: bool = False) -> Iterator[pd.DataFrame]:
    rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
    x, near = directions(rows["vector"]), np.stack(rows["near"].to_numpy())
    ids = [i[:most] for i in rows["ids"]]  # of equal vectors the smaller keys come first
    copies = np.array([len(i) for i in ids])
    for a in range(0, len(wanted), 256):  # bounds the marks of seen rows
        some = wanted.iloc[a : a + 256]
        q = directions(some["query"])
        places, score, scored = walk(x, near, q, most, beam)
        of, at = np.nonzero(score > -np.inf)
        place = places[of, at]
        if whole:
            of, at, place = _missed(x, q, places, score, most)
            scored = np.full(len(some), len(x))
        slices = [slice(b, b + EXACT_ROWS) for b in range(0, len(of), EXACT_ROWS)]
        exact = np.concatenate([np.einsum("ij,ij->i", _exact(rows["vector"].iloc[place[b]]), _exact(some["query"].iloc[of[b]])) for b in slices])
        told = np.where(at == 0, scored[of], 0)
        n = copies[place]
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        every = np.zeros(int(n.sum()), dtype=np.int64)
        every[first] = told
        keys = pd.array([None if i is None else int(i) for p in place for i in ids[p]], dtype="Int64")
        yield pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy()[of], n), "id": keys, "cosine": np.repeat(np.round(exact, 12), n), "scored": every})


def _missed(x: np.ndarray, q: np.ndarray, places: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, its number, place) of the rows of x that a walk found and of those it missed: all that reach its last score.

    What lies nearer to the bound than single precision tells stays, and is ranked by its exact score.
    """
    full = (score > -np.inf).sum(axis=1) >= most
    bound = np.where(full, score[:, : most].min(axis=1), -np.inf) - x.shape[1] * 2.0**-22
    keep = np.zeros((len(q), len(x)), dtype=bool)
    for a in range(0, len(x), 8_192):
        keep[:, a : a + 8_192] = q @ x[a : a + 8_192].T >= bound[:, None]
    of, at = np.nonzero(score > -np.inf)
    keep[of, places[of, at]] = True
    of, place = np.nonzero(keep)
    first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, dtype=bool)
    return of, np.where(first, 0, 1), place


def _exact(lists: pd.Series) -> np.ndarray:
    x = np.stack(lists.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
