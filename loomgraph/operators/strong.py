"""Strongly connected components (circular imports and calls) of a table of edges.

Each node gets a random label; every node then learns the greatest label that reaches it, and the greatest that it
reaches. Where both are one, the node lies in that label's component; other components lie within the nodes that share
both labels, so edges between nodes that don't are dropped, and the rest begins anew with other labels.
Labels move by one edge and then by a jump. A node of one edge in is on a chain: it has a pointer up its chain, which doubles its
length with each round until it stands at a node where edges meet; there, what a node's greatest label has learned
holds for the node too. So rounds follow the logarithm of a chain's length, and beside it the number of meeting places on a
path. A node holds two labels and two pointers; no pairs of nodes are kept.
Before labels are dealt, the edges are contracted as long as that shrinks them. A node without an edge into or out of it goes. One
that has a single edge in, or a single edge out, goes too, and edges lead from what was before it to what was behind it: one less than
there were. No two neighbours go in one step, so a step takes a share of such nodes, and steps follow the logarithm of their
number. Afterwards the steps are undone, last one first: a node lies in the component that holds both a node before it and one behind it.
When LOCAL_EDGES edges or fewer are left, the driver walks them: rounds of tiny tables would take longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut, discard

#: Edges that the driver takes to finish.
LOCAL_EDGES = 1 << 16
#: Contraction goes on while a step leaves no greater share of the edges than this.
SHRINKS = 0.9


def _leaving(edges: DataFrame, step: int) -> DataFrame:
    """node, bare: the nodes that a step takes, those without an edge in or out (bare) and of those with one edge in or out none beside another."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("dst").alias("node"), one.alias("in"), none.alias("out")).unionByName(edges.select(F.col("src").alias("node"), none.alias("in"), one.alias("out")))
    fewest = ends.groupBy("node").agg(F.least(F.sum("in"), F.sum("out")).alias("fewest")).where("fewest <= 1")
    able = fewest.select("node", (F.col("fewest") == 0).alias("bare"), F.struct(F.xxhash64("node", F.lit(step)), "node").alias("draw"))
    drawn = able.where("not bare")
    pairs = edges.join(drawn.select(F.col("node").alias("src"), F.col("draw").alias("src_draw")), "src").join(drawn.select(F.col("node").alias("dst"), F.col("draw").alias("dst_draw")), "dst")
    lost = pairs.select(F.when(F.col("src_draw") < F.col("dst_draw"), F.col("src")).otherwise(F.col("dst")).alias("node"))
    return able.join(lost, "node", "left_anti").select("node", "bare")


def _sides(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, before and node, behind: the edges between the nodes that went and those that stayed; the bare ones have no need of them."""
    before = flagged.where("not dst_bare and src_bare is null").select(F.col("dst").alias("node"), F.col("src").alias("before"))
    behind = flagged.where("not src_bare and dst_bare is null").select(F.col("src").alias("node"), F.col("dst").alias("behind"))
    return before, behind


def _contracted(edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """The edges after a step, and those before it with src_bare and dst_bare: null if that end stays."""
    gone = cut(_leaving(edges, step), "strong-gone")
    flagged = edges
    for end in ("src", "dst"):
        flagged = flagged.join(gone.select(F.col("node").alias(end), F.col("bare").alias(f"{end}_bare")), end, "left")
    flagged = cut(flagged.select("src", "dst", "src_bare", "dst_bare"), "strong-step")
    discard(gone)
    before, behind = _sides(flagged)
    past = before.join(behind, "node").where("before <> behind").select(F.col("before").alias("src"), F.col("behind").alias("dst"))
    kept = flagged.where("src_bare is null and dst_bare is null").select("src", "dst")
    return cut(kept.unionByName(past).distinct(), "strong-edges"), flagged


def _undone(roots: DataFrame, flagged: DataFrame) -> DataFrame:
    """roots (node, root; a node without a row is its own) with the nodes that a step took."""
    before, behind = _sides(flagged)
    rooted = lambda side, end: side.join(roots.withColumnRenamed("node", end), end, "left").select("node", F.coalesce("root", end).alias("root"))
    return roots.unionByName(rooted(before, "before").join(rooted(behind, "behind"), ["node", "root"]).distinct())


def _labels(edges: DataFrame, turn: int) -> DataFrame:
    """node, into (the greatest label that reaches it), out (that it reaches): at first its own; up, down: the only node before and behind it, or null."""
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("at"))
    ends = edges.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(None).cast(edges.schema["src"].dataType).alias("down")).unionByName(edges.select(F.col("src").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("up"), F.col("dst").alias("down")))
    only = lambda side: F.when(F.count(side) == 1, F.min(side)).alias(side)
    return ends.groupBy("node").agg(only("up"), only("down")).select("node", own.alias("into"), own.alias("out"), "up", "down", F.lit(True).alias("moved"))


def _round(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after one edge and one jump."""
    forth = edges.join(state, edges["src"] == state["node"]).select(F.col("dst").alias("node"), "into")
    back = edges.join(state, edges["dst"] == state["node"]).select(F.col("src").alias("node"), "out")
    kept = state.select("node", "into", "out", "up", "down", F.struct("into", "out").alias("was"))
    met = kept.unionByName(forth, allowMissingColumns=True).unionByName(back, allowMissingColumns=True)
    hopped = met.groupBy("node").agg(*[F.max(c).alias(c) for c in ("into", "out", "up", "down", "was")])
    above = state.select(F.col("node").alias("above"), F.col("into").alias("above_into"), F.col("up").alias("above_up"))
    below = state.select(F.col("node").alias("below"), F.col("out").alias("below_out"), F.col("down").alias("below_down"))
    met = hopped.join(above, F.coalesce("up", F.col("into.at")) == F.col("above")).join(below, F.coalesce("down", F.col("out.at")) == F.col("below"))
    now = met.select("node", F.greatest("into", "above_into").alias("into"), F.greatest("out", "below_out").alias("out"), F.when(F.col("up").isNotNull(), F.coalesce("above_up", "up")).alias("up"), F.when(F.col("down").isNotNull(), F.coalesce("below_down", "down")).alias("down"), "was")
    return now.select("node", "into", "out", "up", "down", ((F.col("into") != F.col("was.into")) | (F.col("out") != F.col("was.out"))).alias("moved"))


def _walked(edges: list[tuple]) -> list[tuple]:
    """(node, root) of every end of a few edges: depth-first, with the lowest place on the stack that a node reaches back to."""
    to: dict = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    place, low, held, stack, found = {}, {}, set(), [], []
    for start in to:
        walk = [] if start in place else [(start, iter(to[start]))]
        if walk:
            place[start] = low[start] = len(place)
            stack.append(start)
            held.add(start)
        while walk:
            node, rest = walk[-1]
            after = next(rest, None)
            if after is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == place[node]:
                    while True:
                        member = stack.pop()
                        held.discard(member)
                        found.append((member, node))
                        if member == node:
                            break
            elif after not in place:
                place[after] = low[after] = len(place)
                stack.append(after)
                held.add(after)
                walk.append((after, iter(to.get(after, ()))))
            elif after in held:
                low[node] = min(low[node], place[after])
    return found


def strong_components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component (its least node) and size, for every row of nodes (node) and every end of an edge (src, dst).

    A null end makes no edge; edges that are there twice, or that lead to their own node, change nothing.
    """
    all_nodes = nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))).where("node is not null").distinct()
    now = cut(edges.where("src <> dst").select("src", "dst").distinct(), "strong-edges")
    kind = now.schema["src"].dataType.simpleString()
    roots = now.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    steps = []
    turn = 0
    left = now.count()
    while left:
        shrinks = True
        while shrinks and left > local_edges:
            before, (now, flagged) = now, _contracted(now, len(steps))
            discard(before)
            steps.append(flagged)
            was, left = left, now.count()
            shrinks = left <= SHRINKS * was
        if left <= local_edges:
            walked = _walked([tuple(r) for r in now.select("src", "dst").collect()])
            roots = roots.unionByName(now.sparkSession.createDataFrame([(node, root) for node, root in walked if node != root], roots.schema))
            break
        state = cut(_labels(now, turn), "strong-labels")
        while not state.where("moved").isEmpty():
            after = cut(_round(state, now), "strong-labels")
            discard(state)
            state = after
        roots = roots.unionByName(state.where("into = out").select("node", F.col("into.at").alias("root")).where("node <> root"))
        open_ = state.where("into <> out").select("node", "into", "out")
        ends = open_.select(F.col("node").alias("dst"), F.col("into").alias("dst_into"), F.col("out").alias("dst_out"))
        within = now.join(open_.withColumnRenamed("node", "src"), "src").join(ends, "dst").where((F.col("into") == F.col("dst_into")) & (F.col("out") == F.col("dst_out")))
        before, now = now, cut(within.select("src", "dst"), "strong-edges")
        discard(before)
        left = now.count()
        turn += 1
    for flagged in reversed(steps):
        before, roots = roots, cut(_undone(roots, flagged), "strong-roots")
        discard(before)
        discard(flagged)
    rooted = all_nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return rooted.join(sizes, "root").select("node", "component", "size")


def circular(components: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges within a component of two nodes or more: those that close a circle."""
    of = components.where("size > 1")
    ends = of.select(F.col("node").alias("dst"), F.col("component").alias("dst_component"))
    return edges.join(of.select(F.col("node").alias("src"), "component"), "src").join(ends, "dst").where(F.col("component") == F.col("dst_component")).select("src", "dst", "component")
