"""Graph analytics over (src, dst) edges: extensions on the same tables.

Traversals go hop by hop; each hop joins the frontier with the edges and drops what was reached
before. A hop's result is written to shared storage, so lineage stays one hop long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut


def fan_in(edges: DataFrame) -> DataFrame:
    """node and the number of edges that point to it."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))


def core_nodes(edges: DataFrame, least: int = 10) -> DataFrame:
    """Nodes with at least this fan-in."""
    return fan_in(edges).where(F.col("fan_in") >= least)


def core_files(files: DataFrame, symbol_edges: DataFrame, symbols: DataFrame, least: int = 10, globs: tuple[str, ...] = ()) -> DataFrame:
    """Files with is_core: one of their symbols has the fan-in, or their path matches a glob."""
    hot = symbols.join(core_nodes(symbol_edges, least), symbols["id"] == F.col("node"), "left_semi").select(F.col("file_id").alias("hot_id")).distinct()
    patterns = [F.col("relative_path").rlike(glob_pattern(g)) for g in globs]
    named = F.lit(False)
    for p in patterns:
        named = named | p
    joined = files.drop("is_core").join(hot, F.col("id") == F.col("hot_id"), "left")
    return joined.withColumn("is_core", F.col("hot_id").isNotNull() | named).drop("hot_id")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? don't."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else f"[{c}]" if c not in "^\\" else "\\" + c
            i += 1
    return out + "$"


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge points to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, most_hops: int, reverse: bool = False) -> DataFrame:
    """node and the least number of hops (0 for the seeds) of everything within most_hops of the seeds."""
    step = edges.select(F.col("dst" if reverse else "src").alias("node"), F.col("src" if reverse else "dst").alias("next")).distinct()
    seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "reach")
    frontier = seen
    for hop in range(1, most_hops + 1):
        found = frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def blast_radius(edges: DataFrame, changed: DataFrame, most_hops: int = 5, core: DataFrame | None = None) -> DataFrame:
    """node, hops, score (1 / (1 + hops)) of all that depends on the changed nodes; with core, also whether it is core."""
    found = reach(edges, changed, most_hops, reverse=True).withColumn("score", 1.0 / (1 + F.col("hops")))
    if core is None:
        return found
    return found.join(core.select("node", F.lit(True).alias("is_core")).distinct(), "node", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def changed_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols whose range overlaps a changed range (file_id, from_line, to_line): an equi-join on the file, the overlap as a filter."""
    return symbols.join(lines, "file_id").where((F.col("range.start_line") <= F.col("to_line")) & (F.col("range.end_line") >= F.col("from_line"))).select(F.col("id").alias("node")).distinct()


def subgraph(edges: DataFrame, seeds: DataFrame, most_hops: int) -> DataFrame:
    """Edges among the nodes within most_hops of the seeds, in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = reach(both, seeds, most_hops).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def cycles(edges: DataFrame, most_hops: int = 5) -> DataFrame:
    """Nodes on a cycle of at most most_hops edges, with the length of the shortest."""
    hop = edges.select("src", "dst").distinct()
    paths = hop.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    found = paths.where("start = node").select(F.col("start").alias("node"), F.lit(1).alias("length"))
    for length in range(2, most_hops + 1):
        paths = cut(paths.where("start <> node").join(hop, paths["node"] == hop["src"]).select("start", F.col("dst").alias("node")).distinct(), "cycles")
        found = found.unionByName(paths.where("start = node").select(F.col("start").alias("node"), F.lit(length).alias("length")))
    return found.groupBy("node").agg(F.min("length").alias("length"))


def large_classes(symbols: DataFrame, least_lines: int) -> DataFrame:
    """Classes of at least this many lines."""
    lines = F.col("range.end_line") - F.col("range.start_line") + 1
    return symbols.where((F.col("kind") == "class") & (lines >= least_lines)).select("id", "name", lines.alias("lines"))


def diagnostics_per_file(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Errors, warnings and all diagnostics of every file."""
    counts = diagnostics.groupBy("file_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("total"))
    joined = files.select("id", "relative_path").join(counts, F.col("id") == F.col("file_id"), "left")
    return joined.select("id", "relative_path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "total")])


def recency(commits: DataFrame, now: str, days: int = 30) -> DataFrame:
    """path, last_modified, last_author and the changes of the last days, from commits (path, author, ts)."""
    recent = F.col("ts") > F.expr(f"timestamp_ntz'{now}' - interval {days} days")
    return commits.groupBy("path").agg(F.max("ts").alias("last_modified"), F.max_by("author", F.struct("ts", "author")).alias("last_author"), F.count_if(recent).alias("change_count_30d"))


def tested(symbols: DataFrame, edges: DataFrame, files: DataFrame, test_glob: str = "**/*.test.*") -> DataFrame:
    """Symbols that a test file's edges point to."""
    tests = files.where(F.col("relative_path").rlike(glob_pattern(test_glob))).select(F.col("id").alias("src"))
    called = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return symbols.join(called, "id", "left_semi")


def name_tokens(name) -> Column:
    """The lower-case words of a name: camel case and other marks part them."""
    return F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")), " ")


def search_symbols(symbols: DataFrame, words: str, most: int = 20) -> DataFrame:
    """Symbols by the number of words their names share with the query, then by edit distance and name."""
    hits = F.size(F.array_intersect(name_tokens("name"), F.lit(_wanted(words))))
    return _ranked(symbols.withColumn("hits", hits).where("hits > 0"), words, most)


def _wanted(words: str) -> list[str]:
    return sorted(set(words.lower().replace("_", " ").split()))


def _ranked(found: DataFrame, words: str, most: int) -> DataFrame:
    scored = found.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(words.lower())))
    return scored.orderBy(F.desc("hits"), "distance", "name", "id").limit(most)


def token_index(symbols: DataFrame) -> DataFrame:
    """The inverted index (token, id) of symbols' names: written clustered by token, a search reads the query's words only."""
    return symbols.select("id", F.explode(F.array_distinct(name_tokens("name"))).alias("token")).where("token <> ''").select("token", "id")


def search_index(index: DataFrame, symbols: DataFrame, words: str, most: int = 20) -> DataFrame:
    """As `search_symbols`, through the index: only the symbols that share a word are joined and scored."""
    hits = index.where(F.col("token").isin(*_wanted(words))).groupBy("id").agg(F.count("*").alias("hits"))
    return _ranked(symbols.join(hits, "id"), words, most)


def branch_points(text) -> Column:
    """Places where a text's control flow may part, as complexity is counted: branch words, `&&`, `||` and `??`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?\?")), F.lit(0)).cast("long")


def smells(files: DataFrame, symbols: DataFrame, most_lines: int = 400, most_symbols: int = 30) -> DataFrame:
    """Files that are long, or that declare much: id, relative_path, and the smells' names."""
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    joined = files.select("id", "relative_path", "loc").join(counts, F.col("id") == F.col("file_id"), "left")
    found = F.array_compact(F.array(F.when(F.col("loc") > most_lines, "long file"), F.when(F.col("n_symbols") > most_symbols, "many symbols")))
    return joined.withColumn("smells", found).where(F.size("smells") > 0).select("id", "relative_path", "smells")


def similar_vectors(vectors: DataFrame, query: list[float], most: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The most similar vectors by cosine: a scan with an ordered limit, exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(x * x for x in query) ** 0.5
    cosine = dot(F.col(column), q) / (F.sqrt(dot(F.col(column), F.col(column))) * norm)
    return vectors.where(F.col(column).isNotNull()).select(key, cosine.alias("cosine")).orderBy(F.desc("cosine"), key).limit(most)


def mermaid(edges: DataFrame, most: int = 500) -> str:
    """A flow chart of at most this many edges, as text; a last line tells how many were left out."""
    named = edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    rows = named.orderBy("src", "dst").limit(most + 1).collect()
    rest = [f"  %% {named.count() - most} more edges"] if len(rows) > most else []
    return "\n".join(["flowchart LR", *(f'  {_node(a)}["{a}"] --> {_node(b)}["{b}"]' for a, b in rows[:most]), *rest])


def _node(name: str) -> str:
    return "n_" + "".join(c if c.isalnum() else "_" for c in name)
