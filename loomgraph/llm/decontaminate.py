"""Operator 13: benchmark decontamination by winnowing, in DataFrame functions alone.

Of every `size - GRAM + 1` consecutive word 4-grams the least hash is kept, in documents and in test items; runs of
windows with the same least hash are one fingerprint. A span of `size` words has just so many grams, so equal spans
keep equal hashes: every shared span of that length meets in the join of fingerprints. Hits are then extended to
exact windows, word by word. Items of fewer words are one window, and each such length is winnowed by itself.

The test items' windows are measured first. Up to BROADCAST_BYTES they are broadcast, and documents' fingerprints meet
them where the text is; beyond that fingerprints are shuffled by hash, and candidates are joined with their
texts. Either way nothing but fingerprints, hits and a narrow row a document is shuffled for the rest.

Defined results: null and wordless texts have no words and no windows; texts are taken whole, however long; rows that are there twice
give two rows; items of the same item_id count once, an item without id hits words but is in no list; an
empty table of documents gives no row, one of items no hits; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents
from loomgraph.session import cut

#: Words of a window, and of a gram.
SIZE, GRAM = 10, 4
#: Windows of the items that are sent to every executor, in bytes; more are shuffled.
BROADCAST_BYTES = 32 << 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_key", "task"]
WINDOWS = "hash long, length int, window string, items array<long>, bytes long"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased and other letters as they are."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def winnow(rows: DataFrame, length: int) -> DataFrame:
    """Adds `least`: for each window of `length` words the least hash of its grams, null in a shorter text."""
    gram = min(GRAM, length)
    of_words = ", ".join(f"hashes[i + {j}]" for j in range(gram))
    grams = rows.withColumn("grams", F.expr(f"case when size(hashes) >= {length} then transform(sequence(0, size(hashes) - {gram}), i -> xxhash64({of_words})) end"))
    span = length - gram + 1
    if span == 1:
        return grams.withColumnRenamed("grams", "least")
    of_grams = ", ".join(f"grams[i + {j}]" for j in range(span))
    return grams.withColumn("least", F.expr(f"case when grams is not null then transform(sequence(0, size(grams) - {span}), i -> least({of_grams})) end")).drop("grams")


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.expr("transform(words, x -> xxhash64(x))"))


def text_at(position: str, length: str) -> Column:
    return F.expr(f"concat_ws(' ', slice(words, {position} + 1, {length}))")


def windows(items: DataFrame, size: int = SIZE) -> tuple[DataFrame, list[int]]:
    """WINDOWS of all items, and the lengths that are there (`size` at most)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0").withColumn("length", F.least(F.size("words"), F.lit(size)))
    lengths = sorted(r[0] for r in rows.select("length").distinct().collect())  # `size` values at most
    # the outer form, as a filter inferred from the inner one would compute nested arrays anew for each of their elements
    found = [winnow(hashed(rows.where(F.col("length") == n)), n).select("item_id", "length", "words", F.posexplode_outer("least").alias("at", "hash")).select("hash", "length", text_at("at", "length").alias("window"), "item_id") for n in lengths]
    if not found:
        return items.sparkSession.createDataFrame([], WINDOWS), []
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    grouped = together.groupBy("hash", "length", "window").agg(F.collect_set("item_id").alias("items"))
    return grouped.withColumn("bytes", 64 + F.octet_length("window") + 8 * F.size("items").cast("long")), lengths


def fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """KEY, n_words, words and, exploded, a fingerprint (length, first and end of its run of windows, hash); one row a document has length 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text_key"), F.spark_partition_id().alias("task"), words(F.col("text")).alias("words"))
    rows = hashed(rows)
    for n in lengths:
        rows = winnow(rows, n)
        starts = "filter(sequence(0, size(least) - 1), i -> i = 0 or least[i] <> least[i - 1])"
        rows = rows.withColumn(f"starts{n}", F.expr(f"case when least is not null then {starts} else array() end"))
        run = f"struct({n} as length, a as first, coalesce(get(starts{n}, j + 1), size(least)) as end, least[a] as hash)"
        rows = rows.withColumn(f"runs{n}", F.expr(f"transform(starts{n}, (a, j) -> {run})")).drop("least", f"starts{n}")
    own = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("first"), F.lit(1).alias("end"), F.xxhash64("text_key").alias("hash")))
    runs = F.concat(own, *(f"runs{n}" for n in lengths))
    return rows.select(*KEY, "words", F.explode(runs).alias("run")).select(*KEY, F.size("words").cast("long").alias("n_words"), "words", "run.*")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items whose windows occur), hits (position and length of each), a row for each document."""
    known, lengths = windows(items, size)
    known = cut(known, "windows")
    prints = fingerprints(docs, lengths)
    told = known.select("window", "items", F.col("hash").alias("w_hash"), F.col("length").alias("w_length"))
    same = (F.col("hash") == F.col("w_hash")) & (F.col("length") == F.col("w_length"))
    at = F.explode(F.sequence("first", F.col("end") - 1)).alias("at")
    meets = (F.col("length") == 0) | F.col("window").isNotNull()
    exact = (F.col("length") == 0) | (text_at("at", "length") == F.col("window"))
    if (known.agg(F.sum("bytes")).first()[0] or 0) <= broadcast_bytes:
        met = prints.join(F.broadcast(told), same, "left").where(meets).select("*", at)
    else:
        found = prints.drop("words").join(told, same, "left").where(meets)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text_key"), words(F.col("text")).alias("words"))
        # equal texts are one, so a repeated row isn't a hot key of texts
        texts = texts.groupBy("text_key").agg(F.any_value("words").alias("words"))
        extended = found.where("length > 0").join(texts, "text_key").select(*found.columns, "words", at)
        met = extended.unionByName(found.where("length = 0").select("*", F.array().cast("array<string>").alias("words"), F.lit(0).alias("at")))
    hit = met.where(exact).groupBy(*KEY).agg(
        F.count_if(F.col("length") == 0).alias("rows"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("length") > 0, F.struct("at", "length"))).alias("hits"),
        F.collect_set("items").alias("items"),
    )
    covered = "aggregate(array_sort(hits), struct(0 as upto, 0L as n), (s, x) -> struct(greatest(s.upto, x.at + x.length) as upto, s.n + greatest(0, x.at + x.length - greatest(s.upto, x.at)) as n), s -> s.n)"
    return hit.select("doc_id", "n_words", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "hits", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB SQL.
OP13_SQL = r"""
with i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
d as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as span from (
    select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)),
dw as (
  select row, n, p, array_to_string(w[p:p + n - 1], ' ') as span from (
    select row, w, n, unnest(range(1, len(w) - n + 2)) as p from d join (select distinct n from iw) on len(w) >= n)),
m as (select row, p, dw.n, item_id from dw join iw using (n, span)),
h as (select row, count(distinct place) as n_hit from (select row, unnest(range(p, p + n)) as place from (select distinct row, p, n from m)) group by row),
g as (select row, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from (select distinct row, item_id from m where item_id is not null) group by row)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (row) left join g using (row)
"""
