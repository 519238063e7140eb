"""Operator 9: toxicity by classifier chains.

The categories are predicted one after another: the linear (logistic) model of a category sees the
text's features and the probabilities of all earlier categories. While training, those earlier
probabilities are out-of-fold predictions, so a later model learns how far to trust them.

Features are the presence of hashed words and word beginnings (4 to 8 bytes) of the lower-cased text,
of which the ones that tell the categories apart best are kept. Presence, not frequency: a long text
doesn't thin out what it says once. The models are fitted on a sample of at most `most_labelled`
labelled rows and have `most_features` weights at most (parameters); every text is scored whole.

Defined results: null and empty texts have no feature and the probabilities that this implies; rows
without label aren't learned from; a category with one value only, or no labelled row at all, gets
its share of ones (0 without rows) as probability everywhere; repeated rows are scored each by
themselves; a label row with a null in any category is left out of training; features that tell equally much go by
bucket; a text of any length is read whole; an empty table of documents gives no row; other columns of documents and
labels are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, steps, texts_of
from loomgraph.llm.hashing import Rolling, word_spans
from loomgraph.session import cut, discard, ship

BUCKETS_BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Of 512 to 4096 features, 1024 and fewer find most in held-out thirds of 4,000 labelled rows.
MOST_LABELLED, MOST_FEATURES, FOLDS = 8_000, 1024, 3
#: Bytes that aren't part of a word: ASCII other than letters.
_BREAKS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_ROLLING: list[Rolling] = []


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket), with repeats, of all words and word beginnings."""
    if not _ROLLING:
        _ROLLING.append(Rolling(11))
    rolling = _ROLLING[0]
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    starts, ends = word_spans(data, _BREAKS)
    text = np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), starts, side="right")
    prefix = rolling.prefix(data)
    shift = np.uint64(64 - BUCKETS_BITS)
    where, what = [text], [rolling.ranges(prefix, starts, ends) >> shift]
    for k in PREFIXES:
        long = ends - starts > k
        where.append(text[long])
        what.append(rolling.ranges(prefix, starts[long], starts[long] + k) >> shift)
    return np.concatenate(where), np.concatenate(what).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Weights of the kept features, of earlier categories' probabilities, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def score(self, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(rows, self.weights[cols], minlength=n) + earlier @ self.earlier + self.constant)


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, earlier: np.ndarray, n_features: int, rounds: int = 250, l2: float = 0.02) -> Linear:
    """Logistic regression by full-batch Adam steps; deterministic."""
    n, extra = len(y), earlier.shape[1]
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return Linear(np.zeros(n_features), np.zeros(extra), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    w = np.zeros(n_features + extra + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, w[cols], minlength=n) + earlier @ w[n_features:-1] + w[-1])
        error = p - y
        gradient = np.concatenate([np.bincount(cols, error[rows], minlength=n_features), earlier.T @ error, [error.sum()]])
        gradient[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:n_features], w[n_features:-1], float(w[-1]))


@dataclass
class Chain:
    """The kept buckets, and one linear model a category, in the order of prediction."""

    buckets: np.ndarray
    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.column = np.full(1 << BUCKETS_BITS, -1, dtype=np.int32)
        self.column[self.buckets] = np.arange(len(self.buckets))

    def cells(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, kept feature) pairs."""
        rows, buckets = features(texts)
        cols = self.column[buckets]
        pairs = np.unique(rows[cols >= 0] * max(1, len(self.buckets)) + cols[cols >= 0])
        return np.divmod(pairs, max(1, len(self.buckets)))

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, texts x categories."""
        rows, cols = self.cells(texts)
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, model.score(rows, cols, len(texts), out)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most_labelled: int = MOST_LABELLED, most_features: int = MOST_FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the chain. categories: name -> SQL expression of a 0/1 value over the columns of labels, in chain order.

    A fold is told by a hash of the doc_id, so repeated rows are in one fold. What a fold's predictions come from,
    features included, is chosen and fitted without that fold. At most most_labelled rows are fitted, those of the least
    hashes of their ids (and, where ids are repeated, of their features): first of labels, then of documents that have one.
    """
    spark = docs.sparkSession
    ship(spark)
    names = tuple(categories)
    values = [F.expr(e).cast("double").alias(f"category_{k}") for k, e in enumerate(categories.values())]
    wanted = labels.select(F.col("doc_id").cast("long").alias("label_id"), *values).dropna().orderBy(F.xxhash64("label_id"), *[f"category_{k}" for k in range(len(names))]).limit(most_labelled)
    # at most most_labelled rows of a few numbers
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows, buckets = features(texts_of(batch))
            pairs = np.unique(rows.astype(np.int64) << BUCKETS_BITS | buckets)
            edges = np.searchsorted(pairs >> BUCKETS_BITS, np.arange(batch.num_rows + 1))
            held = pa.array((pairs & ((1 << BUCKETS_BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), held), *batch.columns[2:]], ["doc_id", "buckets", *batch.schema.names[2:]])

    kept = [f"category_{k}" for k in range(len(names))]
    fold_of = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int").alias("fold")
    described = cut(found.select("doc_id", "text", fold_of, *kept).mapInArrow(describe, "doc_id long, buckets array<int>, fold int, " + ", ".join(f"{k} double" for k in kept)), "labelled")
    if described.count() > most_labelled:  # ids that many rows share: the bound holds for rows of documents too
        wide = described
        described = cut(wide.orderBy(F.xxhash64("doc_id", "buckets", *kept)).limit(most_labelled), "labelled")
        discard(wide)
    totals = [described.where(F.col("fold") != f).agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in kept]).first() for f in (-1, *range(folds))]
    if not totals[0]["n"]:
        return Chain(np.zeros(0, np.int64), names, [Linear(np.zeros(0), np.zeros(k), -30.0) for k in range(len(names))])
    # sums over all rows, and over those outside each fold
    outside = [F.lit(1), *(F.when(F.col("fold") != f, 1).otherwise(0) for f in range(folds))]
    sums = [F.sum(w * (F.lit(1) if c == "n" else F.col(c))).alias(f"{c}_{i}") for i, w in enumerate(outside) for c in ("n", *kept)]
    counted = cut(described.select(F.explode("buckets").alias("bucket"), "fold", *kept).groupBy("bucket").agg(*sums), "features")
    chosen = [np.sort(np.array([r[0] for r in telling(counted, i, totals[i], kept, most_features).collect()], dtype=np.int64)) for i in range(folds + 1)]
    union = np.unique(np.concatenate(chosen))
    column = Chain(union, names).column
    shared = spark.sparkContext.broadcast(column)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            cols = shared.value[lists.flatten().to_numpy()]
            keep = np.concatenate([[0], np.cumsum(cols >= 0)])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(keep[offsets], pa.int32()), pa.array(cols[cols >= 0])), *batch.columns[2:]], batch.schema.names)

    rows_of = described.mapInArrow(narrow, described.schema).toPandas()
    rows_of = rows_of.iloc[np.lexsort((rows_of["buckets"].map(lambda b: bytes(np.asarray(b))).to_numpy(), rows_of["doc_id"]))].reset_index(drop=True)
    cols = np.concatenate([np.zeros(0, np.int64), *rows_of["buckets"]]).astype(np.int64)
    rows = np.repeat(np.arange(len(rows_of)), rows_of["buckets"].map(len))
    for table in (described, counted):
        discard(table)
    return chained(rows, cols, rows_of[kept].to_numpy(dtype=float), rows_of["fold"].to_numpy(), [np.searchsorted(union, c) for c in chosen], Chain(chosen[0], names))


def telling(counted: DataFrame, i: int, total, kept: list[str], most: int) -> DataFrame:
    """The buckets with the highest chi-square against any category, by the i-th sums."""
    n, seen = float(total["n"] or 0), F.col(f"n_{i}")
    chi = [F.lit(n) * F.pow(F.col(f"{k}_{i}") * n - seen * F.lit(float(total[k])), 2) / (seen * (F.lit(n) - seen) * F.lit(float(total[k]) * (n - total[k]))) for k in kept if 0 < (total[k] or 0) < n]
    score = F.greatest(*chi, F.lit(0.0)) if chi else F.lit(0.0)
    return counted.where((seen >= 2) & (seen < n)).withColumn("chi", F.coalesce(score, F.lit(0.0))).where("chi > 0").orderBy(F.desc("chi"), "bucket").limit(most).select("bucket")


def chained(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray], chain: Chain) -> Chain:
    """Fits the chain's models to rows of features. chosen: the columns of all rows' features, then those chosen outside each fold."""
    place = [np.full(int(cols.max(initial=-1)) + 1 + max([0, *(int(c.max(initial=-1)) + 1 for c in chosen)]), -1) for _ in chosen]
    for own, c in zip(place, chosen):
        own[c] = np.arange(len(c))

    def cells(i: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features by the i-th choice of the marked rows, which are numbered anew."""
        mine = of[rows] & (place[i][cols] >= 0)
        return (np.cumsum(of) - 1)[rows[mine]], place[i][cols[mine]]

    earlier = np.zeros((len(y), 0))
    for k in range(y.shape[1]):
        chain.models.append(fit(*cells(0, np.ones(len(y), dtype=bool)), y[:, k], earlier, len(chosen[0])))
        if k + 1 < y.shape[1]:  # later categories learn from predictions for rows that the model hasn't seen
            out = np.zeros(len(y))
            for f in range(len(chosen) - 1):
                seen, own = fold != f, fold == f
                if own.any():
                    model = fit(*cells(f + 1, seen), y[seen, k], earlier[seen], len(chosen[f + 1]))
                    out[own] = model.score(*cells(f + 1, own), int(own.sum()), earlier[own])
            earlier = np.column_stack([earlier, out])
    return chain


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and a probability column p_<category> for each category."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(chain)  # at most MOST_FEATURES weights a category, and one table of buckets
    columns = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            p = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(columns)))], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in columns))


#: The table of labels has two values a text, toxic and quality, so the chain has two links, of which one is toxicity.
#: Poor quality comes first: what makes a text poor also hides or explains some of its toxicity.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return classify(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
