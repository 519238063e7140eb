import hashlib
import struct
import zlib

import numpy as np
import pytest
from brute import counted, read, sha

from loomgraph.llm import pieces as P


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.read_model(P.DEFAULT_MODEL))


def check(spark, codec, folder):
    want = []
    for r in read(spark, folder):
        ids = codec.lib.encode(r["text"] or "")
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(codec.lib.decode(ids))})
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    got = [r.asDict() for r in P.op5_sentencepiece(spark, folder).collect()]
    assert counted(want, *columns) == counted(got, *columns)


def test_query(spark, codec, small):
    check(spark, codec, small)


def test_odd(spark, codec, saved, saved_none, odd):
    check(spark, codec, saved)
    assert P.op5_sentencepiece(spark, saved_none).collect() == []
    full = {r["doc_id"]: r for r in P.encode_documents(odd.where("doc_id in (33, 41)")).collect()}
    assert full[33]["ids"] == [] and full[33]["decoded"] == ""
    assert hashlib.sha256(full[41]["decoded"].encode()).hexdigest() == sha(codec.lib.decode(full[41]["ids"]))


@pytest.mark.parametrize("text", ["a b", " a  b ", "", " ", "naïve déjà 😀 x", "日本語\n\t<s>", "▁ and ▁▁ x", "a\0b"])
def test_spans_are_the_librarys(codec, text):
    got = codec.encode([text])[0]
    chars = codec.lib.encode_as_offset_mapping(text)["offsets"] if text else []
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    spans = list(zip(got.begins.tolist(), got.ends.tolist()))
    assert len(spans) == len(got.ids)
    whole = [i for i, k in enumerate(got.ids) if codec.kinds[k] != P.BYTE_PIECE]
    assert [spans[i] for i in whole] == [(at[chars[i][0]], at[chars[i][1]]) for i in whole]
    # together the spans are the text
    assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()


def compiled(mapping):
    """A character map for a few keys, by the double-array's rules, placing children at the first offsets that are free."""
    blob, at = b"", {}
    for key, value in mapping.items():
        at[key], blob = len(blob), blob + value.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(keys, depth, node, label):
        edges = sorted({k[depth] if len(k) > depth else 0 for k in keys})
        base = next(b for b in range(256, 1 << 16) if all((b ^ e) not in used for e in edges))
        used.update(base ^ e for e in edges)
        offset = base ^ node
        units[node] = label | (offset << 10 if offset < 1 << 21 else (offset >> 8 << 10) | 512) | (256 if 0 in edges else 0)
        for e in edges:
            child = base ^ e
            if e == 0:
                units[child] = (1 << 31) | at[next(k for k in keys if len(k) == depth)]
            else:
                place([k for k in keys if len(k) > depth and k[depth] == e], depth + 1, child, e)

    place(list(mapping), 0, 0, 0)
    array = [units.get(i, 0) for i in range(-(-(max(units) + 1) // 256) * 256)]  # the library reads whole KB
    return struct.pack("<I", 4 * len(array)) + struct.pack(f"<{len(array)}I", *array) + blob


def test_character_map(codec):
    mapping = {"ﬁ".encode(): "fi", b"a": "A", b"ab": "X", "Ａ".encode(): "A", "é".encode(): "e", b"\t": " "}
    table = P.CharacterMap(compiled(mapping))
    assert table.longest(b"abc", 0) == (2, b"X") and table.longest(b"ac", 0) == (1, b"A") and table.longest(b"zz", 0) is None
    other = P.Codec(P.read_model(P.DEFAULT_MODEL))
    other.map, other.squeeze, other.dummy_prefix = table, True, True
    source = "ﬁx  abé\t".encode()
    normal, align = other.normalise(source)
    assert normal.decode() == "▁fix▁Xe" and len(align) == len(normal) + 1
    #        ▁        f  i  x  ▁        X  e  end
    assert align.tolist() == [0, 0, 0, 0, 0, 3, 4, 4, 4, 6, 8, len(source)]


def with_character_map(model, table):
    """The model with this character map, with blanks squeezed, as a serialised message of its own."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out, normalizer = b"", b""
    at = 0
    while at < len(model):
        begin = at
        key, at = P._varint(model, at)
        if key & 7 == 2:
            size, at = P._varint(model, at)
            at += size
        elif key & 7 == 0:
            _, at = P._varint(model, at)
        if key >> 3 != 3:
            out += model[begin:at]
    for number, value in ((2, table), (3, 1), (4, 1), (5, 1)):
        normalizer += varint(number << 3 | (2 if isinstance(value, bytes) else 0)) + (varint(len(value)) + value if isinstance(value, bytes) else varint(value))
    return out + varint(3 << 3 | 2) + varint(len(normalizer)) + normalizer


def test_a_model_with_a_character_map(spark, tmp_path):
    """End to end with a compiled character map: ids are the library's for that model, and every id has the source bytes that it came from."""
    mapping = {"ﬁ".encode(): "fi", b"A": "a", b"AB": "x", "Ａ".encode(): "a", "é".encode(): "e", b"\t": " ", b"\n": " ", "½".encode(): "1/2"}
    model = with_character_map(P.read_model(P.DEFAULT_MODEL), compiled(mapping))
    codec = P.Codec(model)
    assert codec.map.units and codec.squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model)
    texts = ["ﬁnd  the A and AB\tcafé", " ½ of it ", "", "plain words", "Ａ\nB AA ABAB", "日本 é", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.encode_documents(docs, str(path)).collect()}
    spelled = lambda piece: piece.replace("▁", " ")
    for i, text in enumerate(texts):
        r = got[i]
        assert r["ids"] == codec.lib.encode(text) and r["decoded"] == codec.lib.decode(r["ids"])
        source = text.encode()
        # spans follow one another, and what lies in each normalises to the piece
        assert all(a <= b for a, b in zip(r["begins"], r["ends"])) and r["begins"] == sorted(r["begins"])
        for k, a, b in zip(r["ids"], r["begins"], r["ends"]):
            piece = spelled(codec.lib.id_to_piece(k)).strip()
            if codec.kinds[k] != P.BYTE_PIECE and piece:
                own = source[a:b].decode(errors="ignore")
                for key, value in sorted(mapping.items(), key=lambda m: -len(m[0])):
                    own = own.replace(key.decode(), value)
                assert piece in own or own.strip() in piece, (text, piece, own)
        assert r["n_tokens"] == len(r["ids"]) and r["n_bytes"] == len(source)


def test_spans_of_the_query(spark, codec, small):
    """spans_crc32 of op5 against the library's own offsets, which count characters."""
    got = {r["doc_id"]: r["spans_crc32"] for r in P.op5_sentencepiece(spark, small).collect()}
    for r in read(spark, small)[:60]:
        text = r["text"] or ""
        ids = codec.lib.encode(text)
        if any(codec.kinds[k] == P.BYTE_PIECE for k in ids):
            continue  # the library gives the bytes of one character one span
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        offsets = codec.lib.encode_as_offset_mapping(text)["offsets"] if text else []
        spans = [at[a] for a, _ in offsets] + [at[b] for _, b in offsets]
        assert got[r["doc_id"]] == zlib.crc32(np.array(spans, dtype="<i8").tobytes())
