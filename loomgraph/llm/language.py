"""Operator 3: language ID by multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are gathered for each language over all training documents, become a
matrix of log-probabilities (languages x buckets, so its size is a parameter's and not the data's),
and are broadcast; a step of texts is scored in numpy, n-gram by n-gram, with segment sums.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text when
nothing could be learned; equal log-probabilities go to the language that sorts first; rows with
null lang aren't learned from; repeated rows count as often as they are there; texts are counted and
scored whole, however long; other columns are left alone, but those that `identify` is told to name.
The matrix has a row for each value of lang in the training rows; more than MOST_LANGUAGES are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from loomgraph.llm.common import documents, free_name, segment_sums, steps, texts_of
from loomgraph.session import ship

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Standard errors by which a text may fall short in its fit.
SIGMAS = 3.0
#: Values of lang whose matrix is broadcast: a column with more doesn't hold languages.
MOST_LANGUAGES = 1000
#: Odd multipliers of the characters of an n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
#: What isn't a letter among ASCII counts as a blank.
_BLANKED = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of this order, text by text, and the n + 1 offsets of the texts."""
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in lowered], out=starts[1:])
    chars = np.where(chars < 128, _BLANKED[np.minimum(chars, 127)], chars)
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    code = np.full(n, order * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
    blank = np.ones(n, dtype=bool)
    for k in range(order):
        part = chars[k : k + n]
        code = (code ^ part) * MULTIPLIERS[k]
        code ^= code >> np.uint32(15)
        blank &= part == 32
    keep = ~blank
    for k in range(1, order):  # n-grams that would reach into the next text
        edge = starts[1:-1] - k
        keep[edge[(edge >= 0) & (edge < n)]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return (code[keep] % np.uint32(BUCKETS)).astype(np.int64), kept[np.minimum(starts, n)]


@dataclass(frozen=True)
class Model:
    """languages, sorted; log_p: languages x BUCKETS; prior: log-probability of each language."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray

    def describe(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior probability, and how well the text fits it.

        The posterior compares languages with one another: over a whole text it is nearly always 1, in junk
        too. The fit compares the text with the language: the mean log-probability of its n-grams less the one that is
        usual in the language, plus SIGMAS standard errors (n-grams overlap, so a third of them count).
        """
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        gained, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for order in ORDERS:
            buckets, offsets = grams(texts, order)
            n += np.diff(offsets)
            for k in range(len(self.languages)):
                gained[:, k] += segment_sums(self.log_p[k][buckets], offsets)
        total = gained + self.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        usual, spread = self.usual
        n = np.maximum(n, 1)
        fit = gained[np.arange(len(texts)), best] / n - usual[best] + SIGMAS * spread[best] / np.sqrt(n / len(ORDERS))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered)], np.where(lettered, score, 0.0), np.where(lettered, fit, -np.inf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        return self.describe(texts)[:2]

    @cached_property
    def usual(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of the log-probability of a language's own n-grams."""
        log_p = self.log_p.astype(np.float64)
        p = np.exp(log_p)
        mean = (p * log_p).sum(axis=1)
        return mean, np.sqrt((p * (log_p - mean[:, None]) ** 2).sum(axis=1))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Learns from the text and lang of every row whose lang isn't null."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            langs, texts = batch.column(1).to_pylist(), texts_of(batch)
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                if len(seen) > MOST_LANGUAGES:
                    raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
                counts = seen.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                counts[BUCKETS] += len(own)
                for order in ORDERS:
                    counts[:BUCKETS] += np.bincount(grams(own, order)[0], minlength=BUCKETS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    # languages x (BUCKETS + 1) rows at most come back, however many documents there are
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has {len(languages)} values, more than {MOST_LANGUAGES}")
    counts = np.zeros((len(languages), BUCKETS + 1))
    number = {lang: k for k, lang in enumerate(languages)}
    counts[found["lang"].map(number).to_numpy(dtype=np.int64), found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    grams_of, texts_of_lang = counts[:, :BUCKETS] + smoothing, counts[:, BUCKETS]
    prior = np.log(texts_of_lang / max(1.0, texts_of_lang.sum())) if languages else np.zeros(0)
    return Model(languages, np.log(grams_of / grams_of.sum(axis=1, keepdims=True)).astype(np.float32), prior)


def identify(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The documents' own columns with the predicted language, its score and, with a third name, its fit; columns that had these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS x 4 bytes
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            pred, *numbers = shared.value.describe(texts_of(batch))
            found = [pa.array(pred, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)][: len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType())
    for name in names[1:]:
        schema = schema.add(name, DoubleType())
    return docs.mapInArrow(run, schema)


def keep_fitting(docs: DataFrame, least_fit: float) -> DataFrame:
    """The documents' own columns, without rows whose text has no determinable language: no letter, or a fit below least_fit.

    The classifier learns from the rows' own lang. Where no row has one, nothing can be learned and no text be said to
    fit or not: then all rows with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score, fit = (free_name(docs, n) for n in ("_lang_pred", "_lang_score", "_lang_fit"))
    found = identify(docs, model, names=(pred, score, fit))
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(fit) >= least_fit)).select(*[f"`{c}`" for c in docs.columns])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
