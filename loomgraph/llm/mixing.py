"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's words are cut to blocks of (nearly) the same number of words. The blocks that the mix
takes are seats: they go to sources by highest quotients votes / (2 seats + 1), votes being the
sources' targets, and no source gets more than three rounds of its own blocks. A source's seats go
to its shards in the same way, so every shard has an integer quota for each source, and each shard
then selects its blocks by a seeded shuffle, without hearing of other shards. Sizes, not texts, are
what moves.

Defined results: null text has size 0 and is never taken; a source without words has target 0; null
source is a source of its own, last in order; repeated rows count each by themselves, whatever ids are null or repeated;
sources of equal quotients go by code point; a text of any length is one row of words, of which any blocks may be taken; an empty table
gives no row; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, free_name, n_words
from loomgraph.session import cut, ship, shuffle_width

#: Most times that the mix may take the same word.
MOST_ROUNDS = 3
BLOCK_WORDS = 16
SEED = 20240611
#: Documents, and words, that a shard holds at most, on average.
SHARD_ROWS, SHARD_WORDS = 50_000, 1 << 25
#: Rows of equal id, source and text that travel as one.
EQUAL_ROWS = 4096


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = MOST_ROUNDS) -> np.ndarray:
    """Shares of the total by weight, none above `most` times its size; the excess goes to the others by weight."""
    goal, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    limit = most * sizes.astype(float)
    while open_.any():
        left = total - goal[~open_].sum()
        share = left * weights * open_ / (weights * open_).sum()
        over = open_ & (share > limit)
        if not over.any():
            goal[open_] = share[open_]
            break
        goal[over] = limit[over]
        open_ &= ~over
    return goal


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague seats by highest quotients, each party up to its own most; equal quotients go to the earlier party."""
    votes, most = votes.astype(float), most.astype(np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    # seats at divisor d are the quotients votes / (2k + 1) above d; find a divisor that gives too few, then deal the rest
    at = lambda d: np.minimum(np.floor(votes / (2 * d) + 0.5), most).astype(np.int64)
    low, high = votes[votes > 0].min() / (2.0 * (most.max() + 1)), votes.max() * 2
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() >= seats:
            low = middle
        else:
            high = middle
        if high - low <= 1e-12 * high:
            break
    got = at(high)
    missing = seats - int(got.sum())
    while missing > 0:  # quotients within rounding of one another
        quotient = np.where(got < most, votes / (2 * got + 1), -1.0)
        first = np.argsort(-quotient, kind="stable")[:missing]
        first = first[quotient[first] > 0]
        got[first] += 1
        missing = seats - int(got.sum())
    return got


def take(sizes: np.ndarray, blocks: int, quota: int, seed: int) -> np.ndarray:
    """Words taken of each document, when `quota` of the shard's blocks are selected, in whole rounds and a seeded rest."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    rounds, rest = divmod(quota, max(1, blocks))
    out = rounds * sizes.astype(np.int64)
    if rest and total:
        chosen = np.sort(np.random.default_rng(seed).permutation(blocks)[:rest])
        edges = np.arange(blocks + 1) * total // blocks
        widths = edges[chosen + 1] - edges[chosen]
        before = np.concatenate([[0], np.cumsum(widths)])

        def upto(x: np.ndarray) -> np.ndarray:
            k = np.searchsorted(edges[chosen], x, side="right") - 1
            inside = np.minimum(x - edges[chosen[np.maximum(k, 0)]], widths[np.maximum(k, 0)])
            return np.where(k >= 0, before[np.maximum(k, 0)] + inside, 0)

        out += upto(ends) - upto(ends - sizes)
    return out


def deal(taken: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The words taken of each group of equal rows, dealt out to its rows as evenly as words can be."""
    each = np.repeat(copies, copies)
    place = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
    all_taken = np.repeat(taken, copies)
    return all_taken // each + (place < all_taken % each)


CELL = "source string, shard int, quota long, blocks long"


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST_ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and order_key (of id and text) of every row. `weights` repeat over the sources in code-point order, null last.

    The sources themselves (a name and a size each) are held by the driver: a mixture's recipe.
    """
    spark = docs.sparkSession
    ship(spark)
    most_rounds = int(most)
    order_key = F.xxhash64("doc_id", "text", F.lit(seed)).alias("order_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), order_key)
    # rows of one name are counted where they are, and at most EQUAL_ROWS of them go to one shard
    equal = rows.groupBy("doc_id", "source", "size", "order_key").agg(F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS))).alias("chunk")
    place = F.when(F.col("chunk") == 0, F.col("order_key")).otherwise(F.xxhash64("order_key", "chunk")).alias("place")
    sized = cut(equal.select("*", chunk).select("doc_id", "source", "size", "order_key", place, F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("n") - EQUAL_ROWS * F.col("chunk")).alias("copies")), "mixing")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in per_source], np.array([r["size"] for r in per_source], dtype=np.int64)
    own_weights = np.array([weights[i % len(weights)] for i in range(len(names))], dtype=float)
    goal = targets(sizes, own_weights, share * float(sizes.sum()), most)
    shards = max(shuffle_width(spark), -(-sum(r["n"] for r in per_source) // SHARD_ROWS), -(-int(sizes.sum()) // SHARD_WORDS))
    block = BLOCK_WORDS
    seats = apportion(goal, int(round(goal.sum() / block)), (most_rounds * -(-sizes // block)).astype(np.int64)) if len(names) else np.zeros(0, np.int64)
    table = spark.createDataFrame([(n, int(z), float(g), int(s)) for n, z, g, s in zip(names, sizes, goal, seats)], "source string, source_size long, target double, seats long")

    sharded = sized.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    cells = sharded.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("size"))
    known = cells.join(table, cells["source"].eqNullSafe(table["source"])).select(cells["source"], "shard", "size", "seats")

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", ignore_index=True)
        size = group["size"].to_numpy(dtype=np.int64)
        blocks = np.where(size > 0, np.maximum(1, np.round(size / block)), 0).astype(np.int64)
        # a source of few words a shard has narrower blocks, and so takes more of them for its seats
        seats = int(round(int(group["seats"].iloc[0]) * block * int(blocks.sum()) / max(1, int(size.sum()))))
        quota = apportion(size, seats, most_rounds * blocks)
        return pd.DataFrame({"source": group["source"], "shard": group["shard"], "quota": quota, "blocks": blocks})

    # a group is one source's shards: a row each
    cell_quotas = known.groupBy("source").applyInPandas(quotas, CELL)

    def select(key: tuple, rows: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id", "size"], ignore_index=True)
        copies = rows["copies"].to_numpy(dtype=np.int64)
        words = rows["size"].to_numpy(dtype=np.int64) * copies
        taken = np.zeros(len(rows), dtype=np.int64)
        of = {None if pd.isna(s) else s: (int(q), int(b)) for s, q, b in zip(quota["source"], quota["quota"], quota["blocks"])}
        codes, found = pd.factorize(rows["source"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(found) + 1))
        for k, source in enumerate(found):
            source = None if pd.isna(source) else source
            own = order[edges[k] : edges[k + 1]]
            q, b = of.get(source, (0, 0))
            name = 0 if source is None else int.from_bytes(source.encode()[:8], "big") + 1
            taken[own] = take(words[own], b, q, [seed, int(key[0]), name])
        each = rows.loc[np.repeat(np.arange(len(rows)), copies), ["doc_id", "source", "size", "order_key"]].reset_index(drop=True)
        return each.assign(taken=deal(taken, copies))

    # pandas would turn a nullable integer into a float
    sharded = sharded.withColumn("doc_id", F.col("doc_id").cast("string"))
    taken = sharded.groupBy("shard").cogroup(cell_quotas.groupBy("shard")).applyInPandas(select, "doc_id string, source string, size long, order_key long, taken long")
    return taken.join(table, taken["source"].eqNullSafe(table["source"])).select(F.col("doc_id").cast("long").alias("doc_id"), taken["source"], "size", "source_size", "target", "taken", "order_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def resample(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents' own columns, each row as often as the mix takes it: taken / size copies, rounded up or down by a seeded draw.

    Whole rows stand for the words that the chosen blocks cover, so a source's words come near its quota and don't
    meet it to the word. The draw is a row's own: by id, source and text, whatever ids are null or repeated. Rows that are
    equal in all three have the same chances, those that the mix takes of them together, and draw each by itself (by
    their place in the table, so a table that is laid out anew may keep others of them). Rows without words are
    never taken, as a mix deals out words.
    """
    own, rate, alone, place, copies, copy = (free_name(docs, n) for n in ("mix_key", "mix_rate", "mix_alone", "mix_place", "mix_copies", "mix_copy"))
    name = lambda order_key, source: F.xxhash64(order_key, source)
    mixed = mix(docs, seed=seed, **options).groupBy(name("order_key", "source").alias(own)).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    rates = cut(mixed.where("taken > 0").select(own, (F.col("taken") / F.col("size")).alias(rate), (F.col("n") == 1).alias(alone)), "mix-rates")
    keyed = docs.withColumn(own, name(F.xxhash64("doc_id", "text", F.lit(seed)), F.col("source").cast("string"))).withColumn(place, F.rand(seed))
    fixed = F.pmod(F.xxhash64(F.col(own), F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # a hash table of rates, so that texts aren't sorted
    joined = keyed.join(rates.hint("shuffle_hash"), own).withColumn(copies, F.floor(F.col(rate) + F.when(F.col(alone), fixed).otherwise(F.col(place))).cast("int"))
    return joined.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*[f"`{c}`" for c in docs.columns])
