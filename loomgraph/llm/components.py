"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut, discard, shuffle_width

EDGES_PER_FILE = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every node of the edges (u, v) with the least node of its component.

    Large-star and small-star steps go on until nothing changes: a number of rounds that grows with the
    logarithm of a component's size. A round's table has a file for each EDGES_PER_FILE edges (steps never add
    any), and is deleted when the next one is written.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(pairs: DataFrame, upward: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        joined = pairs.join(least, "u")
        if upward:  # larger neighbours move to the least of the neighbourhood
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    files = max(1, min(shuffle_width(edges.sparkSession), -(-seen[0] // EDGES_PER_FILE)))
    while seen[0]:
        large = star(both(now), True)
        before, now = now, cut(star(large, False).coalesce(files), "links")
        new = mark(now)
        discard(before)
        if new == seen:
            break
        seen = new
    return now.select("u", F.col("v").alias("root"))
