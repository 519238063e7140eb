import zlib

import corpus_pipeline as C
import numpy as np
from brute import sha

from loomgraph.llm import pieces as P


def test_last_stage_yields_the_encoded_documents(spark, odd, saved):
    codec = P.Codec(P.read_model(P.DEFAULT_MODEL))
    docs = odd.where("doc_id in (0, 33, 36, 41)").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = C.STAGES[-1][1](spark, docs, saved).collect()
    assert {r["doc_id"] for r in got} == {0, 33, 36, 41}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["ids"] == codec.lib.encode(text) and r["decoded"] == codec.lib.decode(r["ids"])
        assert b"".join(text.encode()[a:b] for a, b in zip(r["begins"], r["ends"])) == text.encode()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(r["ids"]), sha(",".join(map(str, r["ids"]))))
        assert r["spans_crc32"] == zlib.crc32(np.array(r["begins"] + r["ends"], dtype="<i8").tobytes())
