"""Operator 8: removal of repeated substrings with a sparse, distributed suffix array.

Every byte is removed that some `size`-byte string covers which also starts earlier. All suffixes of
a corpus, cut to `size` bytes, are hundred times the corpus; so suffixes are sampled by content. Each
window of `size` bytes has an anchor: the gram of GRAM bytes in it with the least hash. Equal windows
have equal anchors at equal offsets, and windows that start side by side mostly share theirs, so the
windows of a document are runs, one an anchor, and the sampled suffixes are those that begin at anchors.

1. The sampled suffixes are range-partitioned by their leading GRAM bytes (ties by the run's hash) with
   splitters from a sample. Each bucket sorts its suffixes by multikey quicksort. Runs that are equal as a
   whole (the GRAM bytes, place of the anchor, length, and a 64-bit hash of all bytes) leave their first
   occurrence; a run whose anchor no other text shares is settled as well. The others are open.
2. Open runs come with their text to the bucket of their suffix; there the suffixes at all their windows
   are sorted by multikey quicksort, byte for byte, and of equal windows the first stays.
3. A suffix that begins as a splitter does may lie on both sides of that boundary, so the two sides are
   compared: such runs are dealt out evenly, sorted in the same way, and the first windows of all parts
   meet under two 64-bit hashes. So a passage that a third of all documents share is no bucket of its own.

Tasks read their buckets as a stream in bucket order. Buckets are as many as the text's bytes ask for
(`Limits.bucket` of text each, about), and a bucket's equal runs are dropped as soon as `Limits.compact` bytes of it
have been read, so what a task holds follows neither the input nor the copies of a passage. The driver holds
splitters only (`Limits.ranges` at most; beyond that a range is cut further by a hash of its grams).

Documents keep their bytes' offsets throughout, and strings are judged on the input.

Defined results: null text is empty, texts shorter than `size` lose nothing; null doc_ids come before
all others; rows that share a doc_id are ordered by a hash of their text, and rows equal in both are
one document, each with its result, so a text that is repeated under null ids is not removed; an empty table gives no row;
other columns are never looked at. Runs of windows that are equal as a whole are known by place, length and a 64-bit
hash of all bytes, and windows across boundaries by two such hashes: among n different ones that agree in the rest, a
false match has the odds n * n / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, id_key, steps
from loomgraph.llm.hashing import Rolling, mix64
from loomgraph.session import cut, ship, shuffle_width

SIZE, GRAM = 100, 32
#: Low bits of a gram's hash that give way to its position; pieces of text are shorter than this.
POSITION_BITS = 28
PIECE_BYTES = 1 << 18
#: Bytes of text to a run, about; runs of one packed row.
RUN_BYTES, PACK_RUNS = 35, 4096
REMOVED, OPEN, CUT = 0, 1, 2
_ROLLING: list[Rolling] = []

#: Columns of packed runs, of open runs (their text follows) and of first windows.
RUN = np.dtype([("lead", "u1", GRAM), ("run", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("count", "u1"), ("offset", "u1")])
TEXT = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("count", "u1"), ("offset", "u1")])
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4")])
SETTLED = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("code", "<i8")])

Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Limits:
    """What tasks hold: none of these changes a result."""

    #: Bytes of text that are cut at once, and whose runs are sent together.
    piece: int = PIECE_BYTES
    batch: int = 8 << 20
    #: Bytes of text of a bucket, about, and bytes of packed runs after which equal ones are dropped.
    bucket: int = 24 << 20
    compact: int = 12 << 20
    #: Ranges that splitters part, and sampled suffixes for each.
    ranges: int = 1 << 16
    sample: int = 64
    #: Windows that are sorted at once.
    windows: int = 1 << 18


def rollings() -> list[Rolling]:
    if not _ROLLING:
        _ROLLING.extend([Rolling(21), Rolling(23)])
    return _ROLLING


def pack(kind: np.dtype, columns: Columns, at: np.ndarray) -> bytes:
    """These members of the columns, one column behind the other: equal beginnings of sorted grams lie side by side."""
    return b"".join(np.ascontiguousarray(columns[n][at]).astype(kind[n].base, copy=False).tobytes() for n in kind.names)


def unpack(kind: np.dtype, blobs: list[bytes]) -> Columns:
    parts: dict[str, list[np.ndarray]] = {n: [] for n in kind.names}
    for blob in blobs:
        rows, at = len(blob) // kind.itemsize, 0
        for n in kind.names:
            item = kind[n]
            part = np.frombuffer(blob, item.base, rows * (item.itemsize // item.base.itemsize), at)
            parts[n].append(part.reshape(rows, *item.shape))
            at += part.nbytes
    return {n: np.concatenate(p) for n, p in parts.items()}


def pieces(texts: list[bytes], size: int, most: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Lists of (number of a text, offset, bytes) of about `most` bytes; parts of a long text overlap by size - 1 bytes."""
    number, offset, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        if len(text) < size:
            continue
        for at in range(0, max(1, len(text) - size + 1), most):
            part = text[at : at + most + size - 1]
            number.append(i), offset.append(at), parts.append(part)
            held += len(part)
            if held >= most:
                yield number, offset, parts
                number, offset, parts, held = [], [], [], 0
    if parts:
        yield number, offset, parts


def runs(parts: list[bytes], size: int = SIZE, gram: int = GRAM) -> Columns:
    """The runs of windows with one anchor: piece, first window's offset in it, windows, anchor's offset from that, hashes of gram and run, the gram's bytes."""
    whole = b"".join(parts)
    data = np.frombuffer(whole, dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    roll = rollings()[0]
    hashes = roll.windows(roll.prefix(data), gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = size - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & low).astype(np.int64)
    # a window belongs to a run only if it lies within one piece
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(ends - size + 1, len(anchor)), -1)
    anchor = np.where(np.cumsum(inside[:-1]) > 0, anchor, -1)
    edge = np.zeros(len(anchor), dtype=bool)
    edge[0] = True
    edge[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(anchor))
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    at = anchor[first]
    piece = np.searchsorted(ends, first, side="right")
    view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
    hashed = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + size - 1).tolist())), dtype=np.uint64, count=len(first))
    lead = np.lib.stride_tricks.sliding_window_view(data, gram)[at]
    return {"piece": piece, "start": first - starts[piece], "count": last - first, "offset": at - first, "gram": hashes[at], "run": hashed, "lead": lead}


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number, which sorts as the bytes do."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


def code(start: np.ndarray, count: np.ndarray, offset: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 20) | (count.astype(np.int64) << 12) | (offset.astype(np.int64) << 4) | kind


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return codes >> 20, codes >> 12 & 255, codes >> 4 & 255, codes & 15


def first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Marks, in this order, where any key differs from the row before."""
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
    return new


def settled(order: np.ndarray, new: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Members of the order that aren't first of their class, but for rows that stand at the very place of the row before."""
    return order[~new & first_of(order, *place)]


def multikey_quicksort(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers, in the strings' order, of the classes of equal `size`-byte strings at these positions of data (which has 8 bytes to spare).

    The strings' characters are words of eight bytes. All parts with more than one string are cut by
    their next character at once; parts of a single string are done, however much of it is unread.
    """
    part = np.zeros(len(at), dtype=np.int64)  # the number of strings in parts before a string's own
    alive = np.arange(len(at))
    for depth in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        if not len(alive):
            break
        word = words_at(data, at[alive] + depth)
        order = np.lexsort((word, part[alive]))
        mine = part[alive[order]]
        new = first_of(order, part[alive], word)
        begin = np.flatnonzero(new)
        outer = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        number = np.cumsum(new) - 1
        inner = begin[number] - outer[np.searchsorted(outer, np.arange(len(mine)), side="right") - 1]
        part[alive[order]] = mine + inner
        sizes = np.diff(np.append(begin, len(mine)))
        alive = alive[order[sizes[number] > 1]]
    return part


def merge_runs(doc: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent windows (document, position) as (document, first, number of windows), 255 at most each."""
    order = np.lexsort((position, doc))
    doc, position = doc[order], position[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (position[1:] != position[:-1] + 1)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
    fresh |= (np.arange(len(doc)) - begin) % 255 == 0
    first = np.flatnonzero(fresh)
    return doc[first], position[first], np.diff(np.append(first, len(doc)))


def _words(grams: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers; the last one is filled up with zeros."""
    short = -grams.shape[1] % 8
    filled = np.pad(grams, ((0, 0), (0, short))) if short else np.ascontiguousarray(grams)
    return filled.view(">u8").astype(np.uint64)


def _keys(grams: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
    """Rows of bytes, with the run's hash behind them, as one comparable string each."""
    whole = np.ascontiguousarray(grams if run is None else np.concatenate([grams, run.astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1))
    return whole.view(f"S{whole.shape[1]}").reshape(-1)


class Bucketing:
    """Splitters between ranges of sampled suffixes. A suffix that begins with a splitter's gram is cut: it may lie on either side."""

    def __init__(self, grams: np.ndarray, run: np.ndarray, subs: int = 1) -> None:
        self.keys, self.lead, self.cut_grams = _keys(grams, run), _words(grams)[:, 0] if len(grams) else np.zeros(0, np.uint64), _keys(grams)
        self.subs, self.n = subs, (len(self.keys) + 1) * subs

    def of(self, grams: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each suffix's bucket, and whether it is cut."""
        words = _words(grams)
        range_, high = np.searchsorted(self.lead, words[:, 0], side="left"), np.searchsorted(self.lead, words[:, 0], side="right")
        is_cut = np.zeros(len(run), dtype=bool)
        close = np.flatnonzero(range_ < high)  # only these begin with the same eight bytes as a splitter
        if len(close):
            range_[close] = np.searchsorted(self.keys, _keys(grams[close], run[close]), side="right")
            is_cut[close] = np.isin(_keys(grams[close]), self.cut_grams)
        if self.subs == 1:
            return range_, is_cut
        mixed = np.where(is_cut, run, np.uint64(0))
        for word in words.T:
            mixed = mix64(mixed + word)
        return range_ * self.subs + (mixed % np.uint64(self.subs)).astype(np.int64), is_cut


def sample_buckets(texts: DataFrame, size: int, limits: Limits) -> Bucketing:
    """Splitters from about `limits.sample` sampled suffixes a range."""
    ship(texts.sparkSession)
    total = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_bytes = total["bytes"] or 0
    wanted = max(shuffle_width(texts.sparkSession), -(-n_bytes // limits.bucket))
    ranges = min(wanted, limits.ranges)
    subs, keys, all_runs = -(-wanted // ranges), ranges * limits.sample, n_bytes / RUN_BYTES
    every = max(1, int(all_runs // (16 * keys)))  # a sixteenth of these documents' suffixes will do
    share = np.uint64(min(1.0, keys * every / max(1.0, all_runs)) * (2**64 - 2**12))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            mark = batch.column(1).to_numpy().view(np.uint64)
            for number, offset, parts in pieces([t.encode() for t in batch.column(0).to_pylist()], size, limits.piece):
                found = runs(parts, size)
                place = mark[np.array(number)[found["piece"]]] + (np.array(offset)[found["piece"]] + found["start"]).astype(np.uint64)
                kept = mix64(place) <= share
                yield pa.RecordBatch.from_arrays([pa.array(_bytes_of(found["lead"][kept]), pa.binary()), pa.array(found["run"][kept].view(np.int64))], ["lead", "run"])

    some = texts.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(every)) == 0).select("text", "mark")
    rows = some.mapInArrow(look, "lead binary, run long").toPandas()  # about limits.sample rows a range
    leads = np.frombuffer(b"".join(rows["lead"]), np.uint8).reshape(-1, GRAM)
    run = rows["run"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(_keys(leads, run), kind="stable")
    marks = order[np.linspace(0, len(order), ranges, endpoint=False).astype(int)[1:]] if len(order) else order
    marks = marks[np.unique(_keys(leads[marks], run[marks]), return_index=True)[1]]
    return Bucketing(leads[marks], run[marks], subs)


def _bytes_of(rows: np.ndarray) -> list[bytes]:
    whole, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1]
    return [whole[k : k + width] for k in range(0, len(whole), width)]


RUNS = "doc long, mark long, code long"
PACKED = "bucket int, kind int, blob binary"


def _texts(docs: DataFrame) -> DataFrame:
    """doc (a sortable id), mark (a hash of the text) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


def _listed(columns: Columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in SETTLED.names], list(SETTLED.names))


def _split(bucket: np.ndarray, most: int = PACK_RUNS) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its members, `most` at a time) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(bucket) else np.zeros(1, dtype=int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for k in range(a, b, most):
            yield int(bucket[order[a]]), order[k : min(b, k + most)]


def dealt(packed: DataFrame, n: int) -> DataFrame:
    """Packed rows in tasks that each read whole buckets, of n, in bucket order."""
    width = shuffle_width(packed.sparkSession)
    if n <= width:  # a bucket a task
        return packed.repartitionById(width, "bucket")
    return packed.repartitionById(width, F.expr(f"cast(cast(bucket as long) * {width} div {n} as int)")).sortWithinPartitions("bucket")


class Bucket:
    """The packed rows of one bucket as they come; `compact` gets their columns when there are many, and returns what must be kept."""

    def __init__(self, kind: np.dtype, compact: Callable[[Columns], tuple[Columns, Columns]], least: int) -> None:
        self.kind, self.compact, self.least = kind, compact, least
        self.held: Columns | None = None
        self.blobs: list[bytes] = []
        self.size, self.limit = 0, least

    def add(self, blob: bytes) -> Columns | None:
        """What is settled, if this blob was one too many."""
        self.blobs.append(blob)
        self.size += len(blob)
        return self.settle() if self.size >= self.limit else None

    def settle(self) -> Columns:
        columns = unpack(self.kind, self.blobs) if self.blobs else self.held
        if self.blobs and self.held is not None:
            columns = {n: np.concatenate([self.held[n], c]) for n, c in columns.items()}
        done, self.held = self.compact(columns)
        self.blobs = []
        self.size = len(next(iter(self.held.values()))) * self.kind.itemsize
        self.limit = max(self.least, 2 * self.size)
        return done


def streamed(batches: Iterator[pa.RecordBatch], kind: np.dtype, compact: Callable[[Columns], tuple[Columns, Columns]], last: Callable[[Columns], Columns | None], least: int) -> Iterator[pa.RecordBatch]:
    """Settled rows of all buckets of a task; rows that are settled already pass through. A bucket is compacted after each `least` bytes or more; `last` gets what it kept."""
    now, bucket = None, None

    def end() -> Iterator[pa.RecordBatch]:
        if bucket is not None:
            for columns in (bucket.settle(), last(bucket.held)):
                if columns is not None and len(columns["doc"]):
                    yield _listed(columns)

    for batch in batches:
        for number, what, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if what == REMOVED:
                yield _listed(unpack(SETTLED, [blob]))
                continue
            if number != now:
                yield from end()
                now, bucket = number, Bucket(kind, compact, least)
            done = bucket.add(blob)
            if done is not None and len(done["doc"]):
                yield _listed(done)
    yield from end()


def _chosen(columns: Columns, at: np.ndarray) -> Columns:
    return {n: c[at] for n, c in columns.items()}


def _suffix_order(columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in suffix order, those of one text by place, with marks of new grams and new runs."""
    lead = columns["lead"]
    data = np.concatenate([np.ascontiguousarray(lead).reshape(-1), np.zeros(8, np.uint8)])
    gram = multikey_quicksort(data, np.arange(len(lead)) * lead.shape[1], lead.shape[1])
    shape = columns["offset"].astype(np.int64) << 8 | columns["count"]
    order = np.lexsort((columns["start"], columns["mark"], columns["doc"], shape, columns["run"], gram))
    new_gram = first_of(order, gram)
    return order, new_gram, new_gram | first_of(order, columns["run"], shape)


def screen(texts: DataFrame, buckets: Bucketing, size: int, limits: Limits) -> DataFrame:
    """Step 1: what is settled as a whole run (REMOVED) and what must be compared window by window (OPEN, CUT)."""
    shared = texts.sparkSession.sparkContext.broadcast(buckets)  # a splitter a range

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, "text", limits.batch):
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place = np.lexsort((mark, doc))  # so that of equal runs the first comes first
            texts_ = batch.column(2).take(pa.array(place)).to_pylist()
            doc, mark = doc[place], mark[place]
            kept: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "count", "offset", "gram", "run", "lead")}
            for number, offset, parts in pieces([t.encode() for t in texts_], size, limits.piece):
                found = runs(parts, size)
                piece = found.pop("piece")
                found["start"] = found["start"] + np.array(offset)[piece]
                found["text"] = np.array(number)[piece]
                for k, v in found.items():
                    kept[k].append(v)
            if not kept["text"]:
                continue
            r = {k: np.concatenate(v) for k, v in kept.items()}
            text = r.pop("text")
            r |= {"doc": doc[text], "mark": mark[text]}
            words, shape = _words(r["lead"]), r["offset"] << 8 | r["count"]
            # of runs that are equal within this batch only the first is sent on; the others are settled
            order = np.lexsort((shape, r["run"], words[:, 0]))
            new = first_of(order, *words.T, r["run"], shape)
            again = settled(order, new, r["doc"], r["mark"], r["start"])
            sent = order[new]
            bucket, _ = own.of(r["lead"][sent], r["run"][sent])
            rows = [(b, OPEN, pack(RUN, r, sent[at])) for b, at in _split(bucket)]
            done = {"doc": r["doc"][again], "mark": r["mark"][again], "code": code(r["start"][again], r["count"][again], r["offset"][again], REMOVED)}
            rows += [(b, REMOVED, pack(SETTLED, done, at)) for b, at in _split(text[again] % own.n)]
            yield _emit(rows)

    def compact(r: Columns) -> tuple[Columns, Columns]:
        order, _, new = _suffix_order(r)
        again = settled(order, new, r["doc"], r["mark"], r["start"])
        return {"doc": r["doc"][again], "mark": r["mark"][again], "code": code(r["start"][again], r["count"][again], r["offset"][again], REMOVED)}, _chosen(r, order[new])

    def open_runs(r: Columns) -> Columns:
        """Runs whose suffix isn't alone; all that begin as a splitter does."""
        order, new, _ = _suffix_order(r)
        number = np.cumsum(new) - 1
        alone = np.empty(len(order), dtype=bool)
        alone[order] = np.bincount(number)[number] == 1 if len(order) else False
        is_cut = shared.value.of(r["lead"], r["run"])[1]
        at = np.flatnonzero(~alone | is_cut)
        return {"doc": r["doc"][at], "mark": r["mark"][at], "code": code(r["start"][at], r["count"][at], r["offset"][at], np.where(is_cut[at], CUT, OPEN))}

    return dealt(texts.mapInArrow(cut_runs, PACKED), buckets.n).mapInArrow(lambda batches: streamed(batches, RUN, compact, open_runs, limits.compact), RUNS)


class OpenRuns:
    """Open runs with their texts."""

    def __init__(self, blobs: list[bytes], size: int) -> None:
        sizes = [int(np.frombuffer(b, "<i8", 1)[0]) for b in blobs]
        self.columns = unpack(TEXT, [b[8 : 8 + n * TEXT.itemsize] for b, n in zip(blobs, sizes)])
        self.data = np.frombuffer(b"".join([*(b[8 + n * TEXT.itemsize :] for b, n in zip(blobs, sizes)), bytes(8)]), np.uint8)
        self.count = self.columns["count"].astype(np.int64)
        length = self.count + size - 1
        self.base = np.cumsum(length) - length
        self.gram_at = self.base + self.columns["offset"]

    def parts(self, gram: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(run, step) of windows, `most` at a time, about; windows that may be equal come together, for their grams and the places in them are."""
        class_ = multikey_quicksort(self.data, self.gram_at, gram)
        order = np.argsort(class_, kind="stable")
        edges = np.flatnonzero(np.r_[first_of(order, class_), True])
        ends = np.cumsum(self.count[order])
        begin = 0
        while begin < len(edges) - 1:
            before = ends[edges[begin] - 1] if edges[begin] else 0
            end = max(begin + 1, int(np.searchsorted(ends[edges[1:] - 1], before + most, side="right")))
            some = order[edges[begin] : edges[end]]
            if end == begin + 1 and ends[edges[end] - 1] - before > most:
                offset = self.columns["offset"][some].astype(np.int64)
                for place in range(int((offset - self.count[some]).min()) + 1, int(offset.max()) + 1):
                    step = offset - place
                    own = (step >= 0) & (step < self.count[some])
                    if own.any():
                        yield some[own], step[own]
            else:
                which = np.repeat(some, self.count[some])
                yield which, np.arange(len(which)) - np.repeat(np.cumsum(self.count[some]) - self.count[some], self.count[some])
            begin = end


def window_hashes(data: np.ndarray, at: np.ndarray, size: int, most: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window; `most` windows are spread out at a time."""
    view = np.lib.stride_tricks.sliding_window_view(data, size)
    ends = np.arange(1, most + 1) * size
    out = np.empty((2, len(at)), dtype=np.uint64)
    for k in range(0, len(at), most):
        text = view[at[k : k + most]].reshape(-1)
        end = ends[: len(text) // size]
        for row, r in zip(out, rollings()):
            row[k : k + most] = r.ranges(r.prefix(text), end - size, end)
    return out[0], out[1]


def _windows_removed(doc: np.ndarray, mark: np.ndarray, position: np.ndarray) -> Columns:
    """Windows as REMOVED runs."""
    keys = np.stack([doc, mark], axis=1)
    found, number = np.unique(keys, axis=0, return_inverse=True) if len(keys) else (keys, np.zeros(0, np.int64))
    which, first, count = merge_runs(number.reshape(-1), position)
    return {"doc": found[which, 0], "mark": found[which, 1], "code": code(first, count, np.zeros(len(first), np.int64), REMOVED)}


def compare(texts: DataFrame, runs_: DataFrame, buckets: Bucketing, size: int, limits: Limits) -> DataFrame:
    """Steps 2 and 3: of the open runs, the windows that also start earlier."""
    shared = texts.sparkSession.sparkContext.broadcast(buckets)
    held = {r["kind"]: r["n"] for r in runs_.groupBy((F.col("code") % 16).alias("kind")).agg(F.sum(F.expr(f"(code >> 12 & 255) + {size - 1}")).alias("n")).collect()}  # a row a kind
    # cut runs are dealt to so many parts, and the first windows of these, each of 36 bytes to about one of text, to so many more
    n_parts = max(1, -(-held.get(CUT, 0) // limits.bucket))
    n_firsts = max(shuffle_width(texts.sparkSession), -(-held.get(CUT, 0) * WINDOW.itemsize // limits.bucket))
    listed = runs_.where(f"code % 16 <> {REMOVED}").groupBy("doc", "mark").agg(F.collect_set("code").alias("codes"))
    # a hash table of codes, so that texts aren't sorted
    joined = texts.join(listed.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "codes")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of every open run, packed for the bucket of its suffix or, if that is cut, for a part."""
        own = shared.value
        for batch in steps(batches, "text", limits.batch):
            rows: list[tuple] = []
            seen: set[tuple[int, int]] = set()
            held_: dict[str, list[np.ndarray]] = {n: [] for n in (*TEXT.names, "kind", "lead", "length", "text")}
            edges, codes = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for doc, mark, text, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), edges[:-1].tolist(), edges[1:].tolist()):
                if (doc, mark) in seen:  # a repeated row
                    continue
                seen.add((doc, mark))
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                start, count, offset, kind = decode(np.sort(codes[a:b]))
                length = count + size - 1
                at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
                lead = np.lib.stride_tricks.sliding_window_view(data, GRAM)[start + offset]
                for n, v in zip(held_, (np.full(len(start), doc), np.full(len(start), mark), start, count, offset, kind, lead, length, data[at])):
                    held_[n].append(v)
            r = {n: np.concatenate(v) for n, v in held_.items()}
            spread = mix64((r["start"] * 31 + r["doc"] + r["mark"]).view(np.uint64)) % np.uint64(n_parts)
            bucket = np.where(r["kind"] == CUT, own.n + spread.astype(np.int64), own.of(r["lead"], np.zeros(len(r["kind"]), np.uint64))[0])
            base = np.cumsum(r["length"]) - r["length"]
            for b, at in _split(bucket, PACK_RUNS // 4):
                own_text = r["text"][np.repeat(base[at] - np.cumsum(r["length"][at]) + r["length"][at], r["length"][at]) + np.arange(r["length"][at].sum())]
                rows.append((b, OPEN, np.array([len(at)], "<i8").tobytes() + pack(TEXT, r, at) + own_text.tobytes()))
            yield _emit(rows)

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each bucket settles, and the first windows of cut suffixes."""
        n, now, blobs = shared.value.n, None, []

        def end() -> Iterator[pa.RecordBatch]:
            held_ = OpenRuns(blobs, size)
            doc_of, mark_of, start_of = held_.columns["doc"], held_.columns["mark"], held_.columns["start"].astype(np.int64)
            for which, step in held_.parts(GRAM, limits.windows):
                at, doc, mark, position = held_.base[which] + step, doc_of[which], mark_of[which], start_of[which] + step
                part = multikey_quicksort(held_.data, at, size)
                order = np.lexsort((position, mark, doc, part))
                new = first_of(order, part)
                again = settled(order, new, doc, mark, position)
                done = _windows_removed(doc[again], mark[again], position[again])
                rows = [(now % n_firsts, REMOVED, pack(SETTLED, done, some)) for some in np.array_split(np.arange(len(done["doc"])), -(-len(done["doc"]) // PACK_RUNS))] if len(again) else []
                if now >= n:
                    once = order[new]
                    one, two = window_hashes(held_.data, at[once], size)
                    firsts = {"one": one, "two": two, "doc": doc[once], "mark": mark[once], "start": position[once]}
                    rows += [(b, OPEN, pack(WINDOW, firsts, some)) for b, some in _split((one % np.uint64(n_firsts)).astype(np.int64))]
                if rows:
                    yield _emit(rows)

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if number != now and blobs:
                    yield from end()
                    blobs = []
                now = number
                blobs.append(blob)
        if blobs:
            yield from end()

    def meet(r: Columns) -> tuple[Columns, Columns]:
        """First windows of all parts: those that aren't the first of all."""
        order = np.lexsort((r["start"], r["mark"], r["doc"], r["two"], r["one"]))
        new = first_of(order, r["one"], r["two"])
        again = settled(order, new, r["doc"], r["mark"], r["start"])
        return _windows_removed(r["doc"][again], r["mark"][again], r["start"][again].astype(np.int64)), _chosen(r, order[new])

    packed = dealt(joined.mapInArrow(fetch, PACKED), buckets.n + n_parts).mapInArrow(sort_suffixes, PACKED)
    return dealt(packed, n_firsts).mapInArrow(lambda batches: streamed(batches, WINDOW, meet, lambda r: None, limits.compact), RUNS)


def covered(n: int, codes: np.ndarray, size: int) -> np.ndarray:
    """Marks the bytes of a text of n bytes that REMOVED runs cover."""
    start, count, _, _ = decode(codes)
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + size - 1, -1)
    return np.cumsum(change[:-1]) > 0


def removal(docs: DataFrame, size: int = SIZE, limits: Limits = Limits()) -> DataFrame:
    """doc, mark, text and the codes of its runs to remove (null: none), a row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs)
    buckets = sample_buckets(texts, size, limits)
    first = cut(screen(texts, buckets, size, limits), "runs")
    again = first.where(f"code % 16 = {REMOVED}").unionByName(compare(texts, first, buckets, size, limits))
    listed = again.groupBy("doc", "mark").agg(F.collect_list("code").alias("codes"))
    return texts.join(listed.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc", "mark", "text", "codes")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for doc, text, codes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = text.encode()
                if codes:
                    gone = covered(len(data), np.array(codes, dtype=np.int64), SIZE)
                    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    rows.append((None if doc == -(2**63) else doc, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
                else:
                    rows.append((None if doc == -(2**63) else doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = removal(documents(spark, sf_dir)).select("doc", "text", "codes")
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and the text that is left of every row; bytes of a character that is cut in two are dropped."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                out.append(data[~covered(len(data), np.array(codes, dtype=np.int64), size)].tobytes().decode(errors="ignore") if codes else text)
            yield pa.RecordBatch.from_arrays([pa.array([None if d == -(2**63) else d for d in batch.column(0).to_pylist()], pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return removal(docs, size).select("doc", "text", "codes").mapInArrow(keep, "doc_id long, text string")
