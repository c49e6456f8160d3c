"""SentencePiece encoding and decoding against the library: all of sf0.001, hard texts, made-up models."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from platelume.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _digests(library, text):
    ids = library.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_against_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op13_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _digests(library, texts[r.doc_id] or "")


def test_cases_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["", None, " ", "   ", "  a  b ", " " * 1500 + "x", "a" * 3000, "▁▁ ▁x", "\0\n\t\r", "é😀ﬁＡ​　", "<s></s><unk><0x41>", "日本語 한국어", "word " * 200_000, "same", "same"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'own' AS N_tokens", "1 AS c0")
    coded = pieces.encode(rows, PATH, ids=True)
    assert coded.columns == ["doc_id", "text", "c0", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    for r in pieces.decode(coded, PATH).collect():
        want = library.encode(r.text or "")
        assert r.token_ids == want and r.decoded == library.decode(want)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _digests(library, r.text or "")
    assert pieces.encode(rows.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert [r.decoded for r in pieces.decode(nothing, PATH).collect()] == ["", ""]


def test_ids_of_any_kind_decode_as_the_library_does():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceCodec.of(PATH)
    rng = random.Random(3)
    for top in (32_000, 262, 8):
        for _ in range(1500):
            ids = [rng.randrange(top) for _ in range(rng.randrange(9))]
            assert b"".join(codec.decode(np.array(ids, np.int64))).decode() == library.decode(ids), ids


def _message(*fields):
    """A message in the wire format: numbers, bytes and floats by field number."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes((n & 127 | 128,)), n >> 7
        return out + bytes((n,))

    out = b""
    for key, value in fields:
        if isinstance(value, float):
            out += varint(key << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(key << 3) + varint(value)
        else:
            out += varint(key << 3 | 2) + varint(len(value)) + value
    return out


def _model(own, prefix, **changes):
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    parts = [(1, _message((1, n.encode()), (2, s), (3, k))) for n, s, k in [*special, *((n, s, changes.get("kind", 1)) for n, s in own)]]
    return _message(*parts, (2, _message((3, 2), (35, 1))), (3, _message((1, b"identity"), (3, int(prefix)), (4, changes.get("trim", 0)), (5, 1))))


def test_models_with_ties_and_merges_out_of_order(tmp_path):
    """Equal scores, pieces that score better than their parts, pieces over spaces, characters that are in pieces only."""
    rng = random.Random(5)
    for n in range(60):
        letters = "ab" if n % 2 else "abc▁"
        names = sorted({"".join(rng.choice(letters + "▁" * (n % 3)) for _ in range(rng.randrange(1, 5))) for _ in range(25)})
        own = [(x, -float(rng.randrange(12 if n % 4 else 1000))) for x in names]
        data = _model(own, n % 5)
        path = tmp_path / f"{n}.model"
        path.write_bytes(data)
        library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceCodec(str(path))
        texts = ["".join(rng.choice("aaabbc  é") for _ in range(rng.randrange(30))) for _ in range(60)] + ["ab" * 500, "a b" * 300]
        for t, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t), (n, t)
            assert b"".join(codec.decode(ids)).decode() == library.decode(ids.tolist())


def test_other_models_are_refused(tmp_path):
    for i, changes in enumerate(({"kind": 4}, {"kind": 5}, {"trim": 1})):
        path = tmp_path / f"{i}.model"
        path.write_bytes(_model([("a", -1.0)], True, **changes))
        with pytest.raises(ValueError, match="only BPE models"):
            pieces.PieceCodec(str(path))
