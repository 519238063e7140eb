"""Operator 12: audit of how filters interact, by aggregated edges of the lattice of their subsets.

A filter's effect depends on the filters before it only through the set of these. So an order of n filters is a path
through the lattice of subsets, from none to all, and a step of it is an edge (filters already applied, next filter):
80 edges for five filters, which serve all 600 steps of the 120 orders. Documents are counted by the set of filters
that they fail; these counts contribute to the edges, and the edges are joined with the steps. What is shuffled is
a narrow row a document (for labels and for equal texts), and what follows has a row for each part and failed set.

Defined results: a null text is the empty text, a null source the part ''; a document of several rows is as many
documents; labels of one doc_id are merged (quality or toxic if any row says so), null labels say nothing; a null
doc_id has no label, is no one's earlier copy, and fails no copy filter; rows of equal doc_id and text aren't copies of one
another; words are counted over texts of any length; an empty table gives no row; other columns are never looked
at. Rows of one doc_id with many different texts meet in one task of the join with labels, as narrow rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD_PATTERN, documents

LETTERS = "ABCDE"
#: The filter that judges a text by the others of the table.
COPIES = "E"
STEPS = "filter_order string, step int, already int, next int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: str = "text", words: str = "words") -> dict[str, Column]:
    """The filters that judge a text by itself: true where it fails. words: its words in order."""
    n, t = F.size(words), F.col(text)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.char_length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def failed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key, failed (bits of own filters, A the lowest)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.withColumn("words", F.array_remove(F.split("text", WORD_PATTERN.replace("[^", "[")), ""))
    bits = sum((F.when(failed, 1 << LETTERS.index(letter)).otherwise(0) for letter, failed in own_failures().items()), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), bits.alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic, 0 or 1."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id match nothing; their second key spreads them over tasks
    spread = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0)))
    joined = spread.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return joined.select("doc_id", "spread", "part", "text_key", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def with_copies(rows: DataFrame) -> DataFrame:
    """part, failed, good, toxic, n: counts of documents, the copy filter's bit set for all of a text but those of its least doc_id.

    No group of equal texts is gathered: its rows are counted by part and label where they are, and what remains of a text
    is a row for each of these.
    """
    group = ["text_key", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy("doc_id", "spread", *group).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    counted = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    firsts = counted.withColumn("least", least).withColumn("firsts", F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    bit = 1 << LETTERS.index(COPIES)
    both = firsts.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed"), F.col("firsts").alias("n")), F.struct((F.col("failed") + bit).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    return both.where("x.n > 0").groupBy("part", "good", "toxic", F.col("x.failed").alias("failed")).agg(F.sum("x.n").alias("n"))


def edges(counts: DataFrame, n_filters: int = len(LETTERS)) -> DataFrame:
    """part, already, next and the sums of COUNTS and shapley for each edge of the lattice."""
    full = (1 << n_filters) - 1
    lattice = F.array(*(F.struct(F.lit(s).alias("already"), F.lit(1 << f).alias("next")) for s in range(full + 1) for f in range(n_filters) if not s >> f & 1))
    at = counts.select("*", F.explode(lattice).alias("e")).select("part", "failed", "good", "toxic", "n", "e.*")
    fails, gone = F.col("failed").bitwiseAND(F.col("next")) != 0, F.col("failed").bitwiseAND(F.col("already")) != 0
    here = fails & ~gone
    of = {"kept": ~fails & ~gone, "removed": here, "redundant": fails & gone, "unique_fails": F.col("failed") == F.col("next"), "good_lost": here & (F.col("good") == 1), "toxic_lost": here & (F.col("toxic") == 1)}
    summed = at.groupBy("part", "already", "next").agg(*(F.sum(F.when(of[name], F.col("n")).otherwise(0)).alias(name) for name in COUNTS))
    # an edge is on |already|! x (filters left after it)! of the paths
    before = F.bit_count("already")
    paths = F.factorial(before) * F.factorial(F.lit(n_filters - 1) - before)
    return summed.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "next")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts: a row for each part and step of each order of the filters."""
    steps = [("".join(p), k + 1, sum(1 << LETTERS.index(x) for x in p[:k]), 1 << LETTERS.index(p[k])) for p in permutations(LETTERS) for k in range(len(LETTERS))]
    counts = with_copies(labelled(failed_sets(docs), labels))
    table = docs.sparkSession.createDataFrame(steps, STEPS)  # 600 rows, whatever the data
    return edges(counts).join(F.broadcast(table), ["already", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same in DuckDB SQL.
OP12_SQL = r"""
with l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by coalesce(text, '')) as least
  from documents),
f as (
  select d.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
    [x.letter for x in [
      {'letter': 'A', 'failed': len(words) < 50},
      {'letter': 'B', 'failed': 100 * len(list_distinct(words)) < 65 * len(words)},
      {'letter': 'C', 'failed': 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text)},
      {'letter': 'D', 'failed': regexp_matches(d.text, '[#$%&*|]')},
      {'letter': 'E', 'failed': coalesce(d.least < d.doc_id, false)}] if x.failed] as failed
  from d left join l using (doc_id)),
c as (select part, good, toxic, failed, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (
  select a.c || b.c || d.c || e.c || g.c as filter_order from x a join x b on a.c <> b.c join x d on d.c not in (a.c, b.c)
  join x e on e.c not in (a.c, b.c, d.c) join x g on g.c not in (a.c, b.c, d.c, e.c)),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
t as (select filter_order, step, filter_order[step] as own, string_split(filter_order[1:step - 1], '') as before from s),
r as (
  select part, filter_order, step, own,
    sum(case when not list_has_any(failed, before) and not list_contains(failed, own) then n else 0 end) as kept,
    sum(case when not list_has_any(failed, before) and list_contains(failed, own) then n else 0 end) as removed,
    sum(case when list_has_any(failed, before) and list_contains(failed, own) then n else 0 end) as redundant,
    sum(case when failed = [own] then n else 0 end) as unique_fails,
    sum(case when not list_has_any(failed, before) and list_contains(failed, own) and good = 1 then n else 0 end) as good_lost,
    sum(case when not list_has_any(failed, before) and list_contains(failed, own) and toxic = 1 then n else 0 end) as toxic_lost
  from c cross join t group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""
