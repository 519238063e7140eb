"""A training-data pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written
as Parquet and read again, so a stage works on all that the one before it kept, and a lost executor
costs the running stage only.

1. language: rows whose text has no determinable language go: it has no letter, or its n-grams are less
   likely in the likeliest language than usual by over -LEAST_FIT nats each (random letters fall short by 4 and
   more, texts of the language by 2 at most); the classifier learns from the rows' own lang.
2. near_dedup: of texts with 0.8 or more of their five-word shingles in common (and chains of these) one row
   stays, that of the smallest doc_id (null ids last, ties by the text's hash).
3. secrets: secrets are replaced by their kind in brackets, and n_chars is counted anew.
4. mixing: rows are repeated or left out as the mix takes their words, by target weights of sources; each row draws by
   itself, so null and repeated ids don't stay or go together.
5. sentencepiece: each row's ids, spans and decoded text, and digests of these.

Null texts have no letter, so they go in the first stage; texts of any length are taken whole; repeated rows are one
after near_dedup; an empty table gives an empty table of the last stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import language, mixing, neardup, pieces, secrets
from loomgraph.session import cut

LEAST_FIT = -3.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_fitting(docs, LEAST_FIT)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: No SQL states the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
