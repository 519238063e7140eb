"""Operator 5: SentencePiece encoding and decoding that keeps every piece's place in the source.

Normalisation walks the source with the longest prefix of the model's compiled character map and
records, for every normalised byte, the source byte it came from. The pieces of a text tile its
normalised bytes, so the running sum of piece lengths, read through that alignment, gives each
piece's span of source bytes.

Defined results: null and empty text give no ids, no spans and an empty decoded text; repeated rows
are encoded each by themselves; a text of any length is encoded whole, by one task; ties of merges are the
library's; an empty table gives no row; other columns are left
alone and never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, steps, texts_of, tokenizer_file
from loomgraph.session import ship

MODEL_FILE = "piece_bpe_32k.model"
SPACE = "▁"
BYTE_PIECE, UNKNOWN_PIECE = 6, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialised message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: a double-array trie over source bytes, then the replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of data[at:]."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, start
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


@dataclass
class Encoded:
    """Ids of one text and, for each, its first and last-exclusive source byte."""

    ids: list[int]
    begins: np.ndarray
    ends: np.ndarray


class Codec:
    """A loaded model: normalise, encode with offsets, decode."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        normalizer: dict[int, int | bytes] = {}
        lengths, kinds = [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                kinds.append(piece.get(3, 1))
                lengths.append(1 if kinds[-1] == BYTE_PIECE else len(piece.get(1, b"")))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.lengths, self.kinds = np.array(lengths, dtype=np.int64), np.array(kinds)
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.id_text = [str(i) for i in range(len(lengths))]

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and their end, the source byte it stands for."""
        space = SPACE.encode() if self.escape else b" "
        if not source:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.squeeze:
            # every character is its own longest prefix: only blanks change their width
            raw = np.frombuffer(source, dtype=np.uint8)
            widths = np.where(raw == 32, len(space), 1)
            lead = len(space) if self.dummy_prefix else 0
            align = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), widths), [len(raw)]])
            return (space if lead else b"") + source.replace(b" ", space), align
        out, align, at = bytearray(), [], 0

        def put(data: bytes, origin: int) -> None:
            out.extend(data)
            align.extend([origin] * len(data))

        if self.dummy_prefix:
            put(space, 0)
        blank = self.squeeze
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                lead = source[at]
                width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = width, source[at : at + width]
            width, target = hit
            for k, piece in enumerate(target.split(b" ")):
                if k and not (blank and self.squeeze):
                    put(space, at)
                    blank = True
                if piece:
                    put(piece, at)
                    blank = False
            at += width
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), np.array([*align, len(source)], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[Encoded]:
        """Ids exactly as the library gives them, each projected to its source bytes."""
        out = []
        for text, ids in zip(texts, self.lib.encode(texts, num_threads=1)):
            source = text.encode()
            normal, align = self.normalise(source)
            edges = np.concatenate([[0], np.cumsum(self.lengths[ids])]) if ids else np.zeros(1, dtype=np.int64)
            if edges[-1] != len(normal):  # an unknown piece, or several merged to one, doesn't tell its length
                edges = self._edges(text, ids, normal)
            out.append(Encoded(ids, align[edges[:-1]], align[edges[1:]]))
        return out

    def _edges(self, text: str, ids: list[int], normal: bytes) -> np.ndarray:
        """Ends of the pieces from the pieces' own strings, which tile the normalised text."""
        pieces = self.lib.encode(text, out_type=str)
        sizes = [1 if self.kinds[i] == BYTE_PIECE else len(p.encode()) for i, p in zip(ids, pieces)]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if edges[-1] != len(normal):
            raise ValueError(f"{len(ids)} pieces of {edges[-1]} bytes don't tile a normalised text of {len(normal)} bytes")
        return edges

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1) if ids else []

    def id_string(self, ids: list[int]) -> str:
        return ",".join(map(self.id_text.__getitem__, ids))


_codecs: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec for each model and Python worker."""
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


ENCODED = ("ids array<int>", "begins array<int>", "ends array<int>", "decoded string")
DIGESTS = ("n_tokens long", "ids_sha256 string", "decoded_sha256 string", "n_bytes long", "spans_crc32 long")


def _listed(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.asarray(r, dtype=kind) for r in rows])))


def __getattr__(name: str) -> str:
    if name == "DEFAULT_MODEL":
        return tokenizer_file(MODEL_FILE)
    raise AttributeError(name)


def encode_documents(docs: DataFrame, model_path: str | None = None, kept: tuple[str, ...] = ENCODED + DIGESTS) -> DataFrame:
    """doc_id, ids, begins, ends (source bytes of each id), the decoded text, and the digests of these, of every row.

    kept: which of the columns leave the worker; a digest is always that of the list that is there.
    """
    model_path = model_path or tokenizer_file(MODEL_FILE)
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))  # one model file: its size doesn't follow the data
    names = ["doc_id", *(c.split()[0] for c in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in steps(batches):
            texts = texts_of(batch)
            found = codec.encode(texts)
            decoded = codec.decode([e.ids for e in found])
            columns = {
                "doc_id": lambda: batch.column(0).cast(pa.int64()),
                "ids": lambda: _listed([e.ids for e in found], np.int32),
                "begins": lambda: _listed([e.begins for e in found], np.int32),
                "ends": lambda: _listed([e.ends for e in found], np.int32),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "n_tokens": lambda: pa.array([len(e.ids) for e in found], pa.int64()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(codec.id_string(e.ids).encode()).hexdigest() for e in found]),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                "n_bytes": lambda: pa.array([len(t.encode()) for t in texts], pa.int64()),
                "spans_crc32": lambda: pa.array([zlib.crc32(np.concatenate([e.begins, e.ends]).astype("<i8").tobytes()) for e in found], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([columns[n]() for n in names], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(["doc_id long", *kept]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), kept=DIGESTS)
