"""Operator 4: token-id files compressed by Re-Pair grammars, with random access.

Documents are encoded in ascending doc_id order. Every shard (a range of doc_ids, written by one
task) is a sequence of blocks of about a million ids. In each block frequent adjacent pairs of
symbols are replaced by nonterminals, again and again, until no pair is frequent (LEAST_COUNT times in
the block, the only stop rule); the block keeps its rules, the expansion length of every rule, and the sequence
that is left. Expansion lengths let a reader find the symbols that cover any range of ids and expand only those.

A pass replaces many pairs at once. While passes shorten the block by much, pairs are counted in a table
of hashed pairs, one candidate a slot, recounted exactly before a rule is made. Then all pairs in busy slots are
counted exactly, and where frequent pairs overlap the more frequent one is replaced.

Block layout (little-endian): header `<4sIQQQQQQ` (magic, width of a symbol in bytes, first
nonterminal, rules, symbols, documents, ids, nonterminal-free flag), then left and right symbols of
the rules, expansion lengths (u4), the sequence, lengths of the documents in ids (u8), doc_ids (i8)
and a bitmap of null doc_ids. Blocks lie in a Parquet dataset in shared storage, one row a block,
so any file system that Spark reaches will do and a lost task leaves no half-written block.

Defined results: null and empty texts have no ids but the end id; null doc_ids come first; rows with
equal doc_ids are ordered by the first 64 characters of text, null first, then by its hash; other columns are never looked at; an empty table gives no block.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, steps, texts_of, tokenizer_file
from loomgraph.llm.hashing import Rolling, mix64
from loomgraph.session import scratch, ship, shuffle_width

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIQQQQQQ")
BLOCK_IDS = 1 << 20
#: Slots of the table in which pairs are counted.
SLOTS_BITS = 18
LEAST_COUNT = 24
#: Part of the sequence that a pass must replace for the next one to count in slots.
BIG_PASS = 0.02
_MIX = np.uint64(0x9E3779B97F4A7C15)

# ---------------------------------------------------------------- Re-Pair


def _pairs(seq: np.ndarray) -> np.ndarray:
    return (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:].astype(np.uint64)


def _slots(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * _MIX) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)


def _apart(at: np.ndarray) -> np.ndarray:
    """Marks, of ascending positions of pairs, every second one in each run of neighbours, so none overlap."""
    n = np.arange(len(at))
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1] + 1
    return (n - np.maximum.accumulate(np.where(new, n, 0))) % 2 == 0


def _in_slots(pairs: np.ndarray, slots: np.ndarray, busy: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are replaced, the number of each one's pair, and the pairs: of each slot one, if it is frequent."""
    table = np.zeros(1 << SLOTS_BITS, dtype=np.uint64)
    table[slots] = pairs  # one pair of each slot is a candidate
    same = table[slots] == pairs
    chosen = np.bincount(slots[same], minlength=1 << SLOTS_BITS) >= least
    taken = same & chosen[slots]
    at = busy[taken]
    apart = _apart(at)
    number = np.cumsum(chosen) - 1
    return at[apart], number[slots[taken]][apart], table[chosen]


def _exactly(pairs: np.ndarray, busy: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all frequent pairs: where two overlap, the one that is there more often."""
    made, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    frequent = counts[number] >= least
    at, number = busy[frequent], number[frequent]
    often = counts[number]
    left, right = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    close = at[1:] == at[:-1] + 1
    left[1:] = close & (often[:-1] > often[1:])
    right[:-1] = close & (often[1:] > often[:-1])
    free = ~(left | right)
    at, number = at[free], number[free]
    apart = _apart(at)
    at, number = at[apart], number[apart]
    worth = np.bincount(number, minlength=len(made))[number] >= least // 4  # the most frequent pair always is
    return at[worth], number[worth], made


def compress(ids: np.ndarray, first: int, passes: int | None = None, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (u4) and rules (n x 2) whose symbols from `first` on are nonterminals; of at most `passes` passes, if that is given."""
    seq, rules, made_so_far = ids.astype(np.uint32), [], 0
    exact, fresh, n = False, None, 0
    while len(seq) > 1 and (passes is None or n < passes):
        n += 1
        if fresh is None:
            pairs = _pairs(seq)
            slots = _slots(pairs)
            busy = np.flatnonzero((np.bincount(slots, minlength=1 << SLOTS_BITS) >= least)[slots])
            pairs = pairs[busy]
            at, which, made = _exactly(pairs, busy, least) if exact else _in_slots(pairs, slots[busy], busy, least)
        else:  # only pairs with a symbol of the last pass can have become frequent
            new = np.flatnonzero(seq >= fresh)
            near = np.unique(np.concatenate([new, new - 1]))
            near = near[(near >= 0) & (near < len(seq) - 1)]
            at, which, made = _exactly(seq[near].astype(np.uint64) << np.uint64(32) | seq[near + 1], near, least)
        if not len(at):
            if exact and fresh is None:  # of all pairs none is frequent
                break
            exact, fresh = True, None
            continue
        exact = exact or len(at) < BIG_PASS * len(seq)
        used = np.bincount(which, minlength=len(made)) > 0
        which, made = (np.cumsum(used) - 1)[which], made[used]
        base = first + made_so_far
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        made_so_far += len(made)
        seq[at] = base + which
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        fresh = base if exact else None
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids under each nonterminal; a rule only uses symbols made before it."""
    lengths = np.zeros(len(rules), dtype=np.int64)
    todo = np.ones(len(rules), dtype=bool)
    while todo.any():
        got = np.zeros(len(rules), dtype=np.int64)
        ready = todo.copy()
        for side in (0, 1):
            symbol = rules[:, side].astype(np.int64)
            leaf = symbol < first
            under = np.where(leaf, 1, lengths[np.where(leaf, 0, symbol - first)])
            got += under
            ready &= under > 0
        lengths[ready] = got[ready]
        todo &= ~ready
    return lengths


@dataclass
class Block:
    """One parsed block."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    seq: np.ndarray
    doc_ids: list[int | None]
    doc_lengths: np.ndarray

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        leaf = symbols < self.first
        return np.where(leaf, 1, self.lengths[np.where(leaf, 0, symbols.astype(np.int64) - self.first)] if len(self.lengths) else 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids under the symbols: the rules' own expansions are spread out once, and then copied."""
        symbols = np.asarray(symbols, dtype=np.int64)
        inner = symbols >= self.first
        if not inner.any():
            return symbols.astype(np.uint32)
        flat, begin = self.spelled
        rule = np.where(inner, symbols - self.first, 0)
        sizes = np.where(inner, self.lengths[rule], 1)
        ends = np.cumsum(sizes)
        source = np.repeat(np.where(inner, begin[rule], 0) - (ends - sizes), sizes) + np.arange(ends[-1])
        out = flat[np.minimum(source, len(flat) - 1)]
        out[(ends - sizes)[~inner]] = symbols[~inner]
        return out

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids under all rules, one rule behind the other, and where each one begins."""
        out = self.first + np.arange(len(self.rules))
        while (out >= self.first).any():
            inner = out >= self.first
            sizes = np.where(inner, 2, 1)
            at = np.cumsum(sizes) - sizes
            grown = np.empty(int(sizes.sum()), dtype=np.int64)
            rule = out[inner] - self.first
            grown[at[~inner]] = out[~inner]
            grown[at[inner]], grown[at[inner] + 1] = self.rules[rule, 0], self.rules[rule, 1]
            out = grown
        return out.astype(np.uint32), np.cumsum(self.lengths) - self.lengths

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document, expanding only the symbols that cover it."""
        ends = np.cumsum(self.widths(self.seq))
        begin = int(self.doc_lengths[:n].sum())
        end = begin + int(self.doc_lengths[n])
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left") + 1
        lead = int(ends[a - 1]) if a else 0
        return self.expand(self.seq[a:b])[begin - lead : end - lead]


def write_block(ids: np.ndarray, doc_ids: list[int | None], doc_lengths: np.ndarray, vocabulary: int) -> bytes:
    seq, rules = compress(ids, vocabulary)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool)).tobytes()
    head = HEADER.pack(MAGIC, width, vocabulary, len(rules), len(seq), len(doc_ids), len(ids), 0)
    return b"".join(
        [head, rules[:, 0].astype(kind).tobytes(), rules[:, 1].astype(kind).tobytes(), expansion_lengths(rules, vocabulary).astype("<u4").tobytes(), seq.astype(kind).tobytes(), np.asarray(doc_lengths, dtype="<u8").tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), nulls]
    )


def read_block(payload: bytes) -> Block:
    magic, width, first, n_rules, n_seq, n_docs, _, _ = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    left, right = take(f"<u{width}", n_rules), take(f"<u{width}", n_rules)
    lengths, seq = take("<u4", n_rules), take(f"<u{width}", n_seq)
    doc_lengths, ids = take("<u8", n_docs), take("<i8", n_docs)
    null = np.unpackbits(np.frombuffer(payload, np.uint8, -1, at), count=n_docs).astype(bool) if n_docs else np.zeros(0, bool)
    return Block(first, np.stack([left, right], axis=1).astype(np.uint32), lengths.astype(np.int64), seq.astype(np.uint32), [None if z else d for d, z in zip(ids.tolist(), null)], doc_lengths.astype(np.int64))


# ---------------------------------------------------------------- encoding

#: Texts of these characters alone are cut to words here; their encoding is that of their words.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]")
_LAST = 0x17F
_IS_PLAIN = np.array([bool(_PLAIN.match(chr(c))) for c in range(_LAST + 1)])
_LOWER = np.array([ord(chr(c).lower()) if _IS_PLAIN[c] else 32 for c in range(_LAST + 1)], dtype=np.uint16)
#: Kinds of lower-case characters, as the tokenizer's own pattern has them.
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.array([BLANK if chr(c).isspace() else DIGIT if 48 <= c <= 57 else LETTER if 97 <= c <= 122 or c >= 0xDF and c != 0xF7 else OTHER for c in range(_LAST + 1)], dtype=np.uint8)
#: What follows an apostrophe as one word with it.
_CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words that an encoder remembers, slots of the table in which it looks first, and characters of new words that it encodes at once.
MOST_WORDS, WORD_SLOTS_BITS, JOINED = 1 << 20, 21, 1 << 16
#: Characters beyond which a word's text is left to the library whole: hashes of short words are as good as the words.
LONG_WORD = 256


def word_bounds(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case characters: runs of letters, single digits, runs of other marks, apostrophes with what they go with."""
    kind = _KIND[chars]
    start = np.empty(len(kind) + 1, dtype=bool)
    start[0], start[-1] = kind[0] != BLANK if len(kind) else False, True
    start[1:-1] = (kind[1:] != BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    mark = np.flatnonzero((chars == 39) & start[:-1])
    after = np.concatenate([chars, np.zeros(3, chars.dtype)])
    for clitic in _CLITICS:
        hit = np.ones(len(mark), dtype=bool)
        for k, c in enumerate(clitic):
            hit &= after[mark + 1 + k] == ord(c)
        at = mark[hit]
        rest = at + 1 + len(clitic)
        start[at + 1] = False
        inside = rest[(rest < len(kind)) & (after[rest] != 0)]
        start[inside[kind[inside] == LETTER]] = True
        mark = mark[~hit]
    stop = np.empty(len(kind), dtype=bool)  # the last character of a word
    stop[:-1] = (kind[:-1] != BLANK) & (start[1:-1] | (kind[1:] == BLANK))
    if len(kind):
        stop[-1] = kind[-1] != BLANK
    return np.flatnonzero(start[:-1]), np.flatnonzero(stop) + 1


class Words:
    """Encodings of words behind one another in one array, found by the words' hashes in a table with open addresses."""

    def __init__(self) -> None:
        self.rolling = Rolling(29)
        self.values = mix64(np.arange(1, _LAST + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << WORD_SLOTS_BITS, dtype=np.uint64)
        self.number = np.zeros(1 << WORD_SLOTS_BITS, dtype=np.int32)
        self.n, self.n_ids = 0, 0
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.begin = np.zeros(1 << 16, dtype=np.int64)

    def hashes(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        roll = self.rolling
        roll._grow(len(chars) + 1)
        prefix = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum(self.values[chars] * roll.powers[: len(chars)], out=prefix[1:])
        return np.maximum(roll.ranges(prefix, starts, ends), np.uint64(1))  # 0 is an empty slot

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; -1 for new ones."""
        slot = (hashes >> np.uint64(64 - WORD_SLOTS_BITS)).astype(np.int64)
        key = self.key[slot]
        out = np.where(key == hashes, self.number[slot], -1)
        on = np.flatnonzero((key != hashes) & (key != 0))
        while len(on):  # taken by another word: the next slot
            slot[on] = (slot[on] + 1) & ((1 << WORD_SLOTS_BITS) - 1)
            key = self.key[slot[on]]
            hit = key == hashes[on]
            out[on[hit]] = self.number[slot[on[hit]]]
            on = on[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new words, with their ids behind one another."""
        self.flat = _roomy(self.flat, self.n_ids + len(ids))
        self.begin = _roomy(self.begin, self.n + len(hashes) + 1)
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[self.n + 1 : self.n + len(hashes) + 1] = self.n_ids + np.cumsum(sizes)
        slot, left = (hashes >> np.uint64(64 - WORD_SLOTS_BITS)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[free]], self.number[slot[free]] = hashes[free], self.n + free
            left = left[self.key[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & ((1 << WORD_SLOTS_BITS) - 1)
        self.n, self.n_ids = self.n + len(hashes), self.n_ids + len(ids)

    def spelled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the n + 1 edges between the words'."""
        begin = self.begin[numbers]
        sizes = self.begin[numbers + 1] - begin
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(begin - edges[:-1], sizes) + np.arange(edges[-1])], edges


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class Encoder:
    """The library's tokenizer with a cache of the encodings of words."""

    def __init__(self, model: bytes) -> None:
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_buffer(model)
        spec = json.loads(model)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        #: The word rule above holds for this normaliser and this pattern only.
        self.by_words = bool(suffix) and [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        #: Whether a token ends a word.
        self.ends = np.zeros(self.size, dtype=bool)
        for token, number in self.lib.get_vocab(with_added_tokens=True).items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)
        self.words = Words()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # as encode(), without offsets

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: many words at once, between blanks, cut where a token ends a word."""
        out, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        ends = np.cumsum([len(w) + 1 for w in words])
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED)))
            part, ids = words[at:end], self._ids(" ".join(words[at:end]))
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) == len(part) and edges[-1] == len(ids):
                out.append(ids)
                sizes.append(np.diff(edges, prepend=0))
            else:
                own = [self._ids(w) for w in part]
                out += own
                sizes.append(np.array([len(x) for x in own]))
            at = end
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        joined = "\n".join(texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        strange = np.flatnonzero((raw > _LAST) | ~_IS_PLAIN[np.minimum(raw, _LAST)])
        whole = set((np.searchsorted(begins, strange, side="right") - 1).tolist())
        for special in self.special:
            if special in joined:
                whole.update(i for i, t in enumerate(texts) if special in t)
        if not self.by_words:
            whole = set(range(len(texts)))
        for i in whole:
            out[i] = self._ids(texts[i])
        chars = _LOWER[np.minimum(raw, _LAST)]
        for i in whole:
            chars[begins[i] : begins[i + 1] - 1] = 32
        starts, ends = word_bounds(chars)
        for i in set((np.searchsorted(begins, starts[ends - starts > LONG_WORD], side="right") - 1).tolist()) - whole:
            out[i] = self._ids(texts[i])
        hashes = self.words.hashes(chars, starts, ends)
        numbers = self.words.find(hashes)
        if (numbers < 0).any():
            if self.words.n + int((numbers < 0).sum()) > MOST_WORDS:
                self.words.clear()
                numbers[:] = -1
            missed = np.flatnonzero(numbers < 0)
            new, first = np.unique(hashes[missed], return_index=True)
            if len(new) > MOST_WORDS:  # one text of more words than are remembered
                return [self._ids(t) for t in texts]
            at, lowered = missed[first], chars.tobytes().decode("utf-16-le")
            self.words.add(new, *self._words([lowered[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            numbers[missed] = self.words.find(hashes[missed])
        ids, edges = self.words.spelled(numbers)
        cuts = edges[np.searchsorted(starts, begins)].tolist()
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if out[i] is None:
                out[i] = ids[a:b]
        return out


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


# ---------------------------------------------------------------- writing and reading


def __getattr__(name: str) -> str:
    if name == "DEFAULT_TOKENIZER":
        return tokenizer_file(TOKENIZER_FILE)
    raise AttributeError(name)


BLOCKS = "shard int, block int, before long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int | None = END_ID) -> str:
    """Encodes docs in ascending doc_id order to blocks under `path` (by default a scratch folder of shared storage); returns it."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer or tokenizer_file(TOKENIZER_FILE), "rb") as file:
        model = spark.sparkContext.broadcast(file.read())  # one tokenizer file: its size doesn't follow the data
    path = path or scratch(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = encoder_of(model.value)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        end = np.array([] if end_id is None else [end_id], dtype="<u4")

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            n = sum(lengths)
            payload = write_block(np.concatenate(ids), doc_ids, np.array(lengths), max(encoder.size, (end_id or 0) + 1))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "before", "n_ids", "payload"])
            block, before = block + 1, before + n
            ids.clear(), doc_ids.clear(), lengths.clear()
            return out

        for batch in steps(batches):
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch))):
                ids += [own, end]
                doc_ids.append(doc_id)
                lengths.append(len(own) + len(end))
            if sum(lengths) >= BLOCK_IDS:
                yield flush()
        if doc_ids:
            yield flush()

    text = F.col("text").cast("string")
    # a doc_id that many rows share, as null ids do, is no range of its own; rows that are equal are in no order
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(text, 1, 64).alias("lead"), F.xxhash64(text).alias("mark"), F.rand(11).alias("spread"))
    ordered = keyed.repartitionByRange(shuffle_width(spark), "doc_id", "lead", "mark", "spread").sortWithinPartitions("doc_id", "lead", "mark").select("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the blocks."""
    return _decoded(spark, path, "n_tokens long, ids_crc32 long", lambda own: (len(own), zlib.crc32(own.astype("<u4").tobytes())))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves."""
    return _decoded(spark, path, "ids array<int>", lambda own: (own.tolist(),))


def _decoded(spark: SparkSession, path: str, columns: str, of) -> DataFrame:
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row a shard: the shards are as many as the writer's tasks
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
        for batch in batches:
            for shard, before, payload in zip(*(batch.column(k) for k in range(3))):
                parsed = read_block(payload.as_py())
                ids, edges = parsed.ids(), np.concatenate([[0], np.cumsum(parsed.doc_lengths)])
                rows = [of(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                cells = [pa.array([r[k] for r in rows], kinds[n]) for k, n in enumerate(names)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), pa.array(parsed.doc_ids, pa.int64()), pa.array(before.as_py() + edges[:-1], pa.int64()), *cells], ["shard", "doc_id", "inside", *names])

    rows = blocks.select("shard", "before", "payload").mapInArrow(run, f"shard int, doc_id long, inside long, {columns}")
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), *names)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(documents(spark, sf_dir)))
