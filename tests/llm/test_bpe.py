import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_as_the_library(text):
    ids = CODEC.encode([text])[0]
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 511, 512, 513, 3000])
def test_long_pieces(n):
    rng = random.Random(n)
    for alphabet in ("a", "ab", "theinreation", "é🙂"):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert CODEC.encode([text])[0] == REFERENCE.encode_ordinary(text)


def test_matrix_and_heap_agree():
    rng = random.Random(9)
    for _ in range(200):
        piece = "".join(rng.choice("thereinglys") for _ in range(rng.randrange(2, 120)))
        if piece.encode() not in RANKS:
            assert CODEC._merge_long(piece.encode()) == CODEC.encode_pieces([piece])[0]


def test_documents(odd_docs, odd_rows, no_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.bpe_encode(odd_docs, path, P.PATTERN, decoded=True).collect()
    want = [(i, REFERENCE.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows]
    assert sorted(map(repr, ((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got))) == sorted(map(repr, want))
    assert bpe.bpe_encode(no_docs, path, P.PATTERN).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(odd_docs, path, P.PATTERN), path).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in odd_rows)


def test_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op7_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
