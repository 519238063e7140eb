"""Shared pieces of the training-data operators: word rules, text batches, range parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD_BREAKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds at a time, but for a longer text: its arrays stay in a core's cache.
STEP_BYTES = 3 << 17

_TO_SPACE = bytes(32 if chr(b) in WORD_BREAKS else b for b in range(256))
_TO_SPACE_LOWER = bytes(b + 32 if 65 <= b <= 90 else c for b, c in zip(range(256), _TO_SPACE))


def words(text: str) -> list[str]:
    """The words of a text; str.split() would also break at other Unicode spaces."""
    return [w.decode() for w in byte_words(text.encode("utf-8", "surrogatepass"))]


def byte_words(data: bytes, lower: bool = False) -> list[bytes]:
    """The words of UTF-8 bytes; with lower, A-Z become a-z and other letters stay."""
    return [w for w in data.translate(_TO_SPACE_LOWER if lower else _TO_SPACE).split(b" ") if w]


def n_words(text: Column) -> Column:
    """Number of words of a text column on the JVM side; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def steps(batches: Iterator[pa.RecordBatch], size_of: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches to slices of about `most` bytes of one column, so memory doesn't follow the batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
        part = (np.cumsum(sizes) // most).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and the n + 1 offsets of each text."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.int64 if values.dtype.kind in "iub" else np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


def hex64(values: np.ndarray) -> list[str]:
    return [format(v, "016x") for v in values.tolist()]


def id_key(name: str = "doc_id") -> Column:
    """A sortable, never-null form of an integer id: null ids come first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of docs has it (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file; only the driver asks for it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
