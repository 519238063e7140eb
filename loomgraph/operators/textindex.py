"""A stored full-text index of symbols' names: BM25 over their words, and trigrams for misspelt ones.

The index lies beside a store's tables, in segments. A segment holds, for the files that changed since the one before it, the
postings of all their symbols (token, symbol, how often, the name's length), in buckets by a hash of the token and sorted
by it, the trigrams of their tokens likewise, and the list of those files. A later segment that lists a file overrides
what earlier ones hold of it. So an update writes what its files need and nothing else; it finds these files from
the buckets of the symbol table whose versions moved. A search reads the buckets of the query's tokens in each segment,
and the lists of files; document frequencies are counts of the live postings read. Segments are merged when there
are more than MOST_SEGMENTS.

The pointer `_INDEX`, moved in one rename, names the segments, the versions of the symbol table that they cover, and
the numbers of symbols and of words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import name_tokens
from loomgraph.operators.upsert import Store, bucket_of
from loomgraph.session import shuffle_width, shuffles_dropped

#: Buckets of tokens and of trigrams, and segments before a merge.
BUCKETS, MOST_SEGMENTS = 32, 8
#: Tasks that write a bucket.
PARTS = 4
#: Saturation of repeated words, and weight of a name's length.
K1, B = 1.2, 0.75
#: Edits between a misspelt word and one that stands in for it, and how many may.
MOST_EDITS, STAND_INS = 2, 3
POSTINGS = "token string, id string, file_id string, name string, times int, length int"
GRAMS = "gram string, token string"


def tokens(name: Column | str) -> Column:
    """The words of a name, repeats included."""
    return F.array_remove(name_tokens(name), "")


def grams(token: Column | str) -> Column:
    """The distinct trigrams of a word with a mark before and behind it."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def postings(symbols: DataFrame) -> DataFrame:
    """POSTINGS of symbols (id, file_id, name), whose ids are unique; each comes of its symbol's row alone."""
    named = symbols.select("id", "file_id", "name", tokens("name").alias("words"))
    # the outer one, as else a filter on the words is put below, which parts each name once more
    each = named.select("*", F.posexplode_outer("words").alias("at", "token")).where(F.array_position("words", F.col("token")) == F.col("at") + 1)
    times = F.size("words") - F.size(F.array_remove("words", F.col("token")))
    return each.select("token", "id", "file_id", "name", times.alias("times"), F.size("words").alias("length"))


def _changed(now: DataFrame, was: DataFrame) -> DataFrame:
    """file_id of the files whose symbols (id, file_id, name) are others now than they were.

    A file's symbols are told apart by 128 bits of their hashes, joined by exclusive or: a row that both have leaves nothing. So each
    task of a scan hands on a row a file, not its symbols.
    """
    both = now.withColumn("side", F.lit(1)).unionByName(was.withColumn("side", F.lit(-1)))
    told = both.groupBy("file_id").agg(F.bit_xor(F.xxhash64("id", "name")).alias("h"), F.bit_xor(F.xxhash64(F.lit("symbol"), "id", "name")).alias("g"), F.sum("side").alias("more"))
    return told.where("h <> 0 or g <> 0 or more <> 0").select("file_id")


def _counted(rows: DataFrame) -> tuple[int, int]:
    """Symbols and words of postings: those of one length have that many words each."""
    by_length = [(r["length"], r["words"]) for r in rows.groupBy("length").agg(F.sum("times").alias("words")).collect()]
    return sum(words // length for length, words in by_length), sum(words for _, words in by_length)


def bm25(hits: DataFrame, n_symbols: int, n_words: int, words: str, most: int) -> DataFrame:
    """id, file_id, name, score of the best of postings: by score (to 9 digits), then edit distance, name and id."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_symbols) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(n_words / max(1, n_symbols)))
    scored = hits.join(F.broadcast(df), "token").withColumn("part", idf * F.col("times") * (K1 + 1) / (F.col("times") + norm))  # a row a word of the query
    summed = scored.groupBy("id", "file_id", "name").agg(F.round(F.sum("part"), 9).alias("score"))
    return summed.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(words.lower()))).orderBy(F.desc("score"), "distance", "name", "id").limit(most).select("id", "file_id", "name", "score")


def scan_search(symbols: DataFrame, words: str, most: int = 20) -> DataFrame:
    """What `SymbolIndex.search` answers, from the symbols themselves."""
    all_words = symbols.select(F.size(tokens("name")).cast("long").alias("n")).where("n > 0").agg(F.count("*").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    return bm25(postings(symbols).where(F.col("token").isin(*_asked(words))), all_words["symbols"], all_words["words"], words, most)


def _asked(words: str) -> list[str]:
    return sorted(set(words.lower().replace("_", " ").split()))


class SymbolIndex:
    """The index of one store's symbols."""

    def __init__(self, store: Store) -> None:
        self.store, self.spark, self.path = store, store.spark, f"{store.path}/search"

    # -- pointer

    def state(self) -> dict:
        """segments, layout (versions of the symbol table), symbols and words; all empty before the first refresh."""
        pointer = self.store._path(f"{self.path}/_INDEX")
        if not self.store._fs.exists(pointer):
            return {"segments": [], "layout": [], "symbols": 0, "words": 0}
        return json.loads(self.store._read(pointer))

    # -- writing

    def refresh(self) -> bool:
        """Brings the index up to the store's symbols; whether there was anything to do."""
        with self.store._locked() as own:
            state, layout = self.state(), self.store.layout()["symbol"]
            if state["layout"] == layout:
                return False
            moved = len(layout) != len(state["layout"])
            old_layout = [0] * len(layout) if moved else state["layout"]
            touched = [b for b, v in enumerate(layout) if moved or v != old_layout[b]]
            now = self.store.read("symbol", layout, touched).select("id", "file_id", "name")
            if moved:  # first, or dealt out anew: all of it
                was = self._live(state).select("id", "file_id", "name").distinct() if state["segments"] else now.where("false")
            else:
                was = self.store.read("symbol", old_layout, touched).select("id", "file_id", "name")
            number = max(state["segments"], default=0) + 1
            self._clear(number)
            with shuffles_dropped(self.spark):
                _changed(now, was).write.parquet(f"{self.path}/files/s={number}")
            files = self.spark.read.schema("file_id string").parquet(f"{self.path}/files/s={number}")
            fresh = now.join(files, "file_id", "left_semi") if state["segments"] else now
            with shuffles_dropped(self.spark):
                self._segment(postings(fresh), number)
            more = _counted(self._read({"segments": [number]}, "postings", POSTINGS, None))
            less = _counted(postings(was.join(files, "file_id", "left_semi"))) if state["segments"] else (0, 0)
            state = {"segments": [*state["segments"], number], "layout": layout, "symbols": state["symbols"] + more[0] - less[0], "words": state["words"] + more[1] - less[1]}
            if len(state["segments"]) > MOST_SEGMENTS:
                self._clear(number + 1)
                self._segment(self._live(state), number + 1)
                files.where("false").write.parquet(f"{self.path}/files/s={number + 1}")
                state["segments"] = [number + 1]
            self._point(own, state)
            return True

    def _segment(self, rows: DataFrame, number: int) -> None:
        def write(name: str, table: DataFrame, key: str, of: str) -> None:
            # a word that most names share, and so its bucket, goes to PARTS tasks
            table.withColumn("b", bucket_of(F.col(key), BUCKETS)).repartition(max(BUCKETS, shuffle_width(self.spark)), "b", bucket_of(F.col(of), PARTS)).sortWithinPartitions("b", key).write.partitionBy("b").parquet(f"{self.path}/{name}/s={number}")

        write("postings", rows, "token", "id")
        words = self._read({"segments": [number]}, "postings", POSTINGS, None).select("token").distinct()  # as written: their column of tokens alone is read
        write("grams", words.select(F.explode(grams("token")).alias("gram"), "token"), "gram", "token")

    def _clear(self, number: int) -> None:
        """What a crashed refresh left of a segment that no pointer names."""
        for name in ("postings", "grams", "files"):
            self.store._fs.delete(self.store._path(f"{self.path}/{name}/s={number}"), True)

    def _point(self, own: str, state: dict) -> None:
        if not self.store._owned(own):
            raise RuntimeError(f"{self.path} was taken over by another writer; nothing is committed")
        self.store.move(f"{self.path}/_INDEX", json.dumps(state))

    def vacuum(self) -> None:
        """Removes segments that the pointer doesn't name; readers of older states must be done."""
        kept = {f"s={n}" for n in self.state()["segments"]}
        for name in ("postings", "grams", "files"):
            folder = self.store._path(f"{self.path}/{name}")
            for found in self.store._fs.listStatus(folder) if self.store._fs.exists(folder) else ():
                if found.getPath().getName() not in kept:
                    self.store._fs.delete(found.getPath(), True)

    # -- reading

    def _read(self, state: dict, name: str, schema: str, keys: list[str] | None) -> DataFrame:
        """Rows with their segment `s`, of some keys' buckets or of all."""
        wanted = range(BUCKETS) if keys is None else sorted({r[0] for r in self.spark.createDataFrame([(k,) for k in keys], "k string").select(bucket_of(F.col("k"), BUCKETS)).collect()})
        folders = [f"{self.path}/{name}/s={n}/b={b}" for n in state["segments"] for b in wanted]
        there = [f for f in folders if self.store._fs.exists(self.store._path(f))]
        if not there:
            return self.spark.createDataFrame([], f"{schema}, s int")
        rows = self.spark.read.schema(f"{schema}, s int").option("basePath", f"{self.path}/{name}").parquet(*there)
        return rows if keys is None else rows.where(F.col(schema.split()[0]).isin(*keys))

    def _live(self, state: dict, keys: list[str] | None = None) -> DataFrame:
        """Postings of which no later segment lists the file."""
        rows = self._read(state, "postings", POSTINGS, keys)
        if not state["segments"]:
            return rows.drop("s")
        listed = [f"{self.path}/files/s={n}" for n in state["segments"]]
        last = self.spark.read.schema("file_id string, s int").option("basePath", f"{self.path}/files").parquet(*listed).groupBy("file_id").agg(F.max("s").alias("last"))
        return rows.join(last, "file_id", "left").where(F.col("last").isNull() | (F.col("s") >= F.col("last"))).select(*[c.split()[0] for c in POSTINGS.split(", ")])

    def search(self, words: str, most: int = 20) -> DataFrame:
        """id, file_id, name, score of the best symbols for the words."""
        state = self.state()
        return bm25(self._live(state, _asked(words)), state["symbols"], state["words"], words, most)

    def suggest(self, word: str) -> list[str]:
        """Words of the index that stand in for one that may be misspelt: by edits, then by shared trigrams, then by name."""
        own = word.lower()
        marks = [r[0] for r in self.spark.range(1).select(F.explode(grams(F.lit(own)))).collect()]
        shared = self._read(self.state(), "grams", GRAMS, marks).select("gram", "token").distinct().groupBy("token").agg(F.count("*").alias("shared"))
        near = shared.withColumn("edits", F.levenshtein("token", F.lit(own), MOST_EDITS)).where("edits >= 0")
        return [r["token"] for r in near.orderBy("edits", F.desc("shared"), "token").limit(STAND_INS).collect()]

    def search_misspelt(self, words: str, most: int = 20) -> DataFrame:
        """As `search`, each word that no live name has replaced by those that stand in for it."""
        asked = _asked(words)
        known = {r[0] for r in self._live(self.state(), asked).select("token").distinct().collect()} if asked else set()
        return self.search(" ".join(t for w in asked for t in ([w] if w in known else self.suggest(w) or [w])), most)
