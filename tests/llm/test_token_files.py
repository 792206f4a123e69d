import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridelens.llm import token_files as TF
from ridelens.llm.common import scratch

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
OURS = TF.ChunkEncoder(open(PATH, encoding="utf-8").read(), np.dtype("<u2"))


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aB é̈ß's12 Σσς.,;:!? \n\tİ<|endoftext|>", max_size=60))
def test_chunks_as_the_library(text):
    assert np.frombuffer(OURS.encode(text), "<u2").tolist() == ids_of(text)


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(t or ""), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(spark, path):
    return [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"])))
            for r in TF.read_token_files(spark, path).collect()]


def test_round_trip_of_odd_rows(spark, odd_docs, odd_rows):
    path = scratch(spark, "tokens")
    parts = TF.write_token_files(odd_docs, path, PATH, 1, partitions=3).collect()
    want = expected(odd_rows)
    assert sorted(map(repr, read_back(spark, path))) == sorted(map(repr, want))
    assert sum(p["n_docs"] for p in parts) == len(odd_rows)
    assert sorted(p["base"] for p in parts)[0] == 0


def test_empty_table(spark, no_docs):
    path = scratch(spark, "tokens")
    TF.write_token_files(no_docs, path, PATH, 1)
    assert read_back(spark, path) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, TF.op8_token_files(spark, d).collect())) == expected(rows)


UNTOUCHED = Tokenizer.from_file(PATH)
PIECES = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "one", "É", "Σ", "\u0301",
                          " ", "\n", "\t", ".", "'s", "12", "İ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=40))
def test_special_tokens_as_the_untouched_library(text):
    assert np.frombuffer(OURS.encode(text), "<u2").tolist() == UNTOUCHED.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_document(spark):
    path, rows = scratch(spark, "tokens"), [(1, "one <|endoftext|> two"), (2, "x<|STARTOFTEXT|><|startoftext|>.")]
    TF.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, 1, partitions=2)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in TF.read_token_files(spark, path).collect()}
    assert got == {i: [*UNTOUCHED.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    assert got[1] == [637, 49407, 1237, 1]


def test_rows_without_an_id_are_split(spark):
    """All rows share the null id; order of texts and starts hold over the parts."""
    rows = [(None, f"text number {k}") for k in range(400)]
    path = scratch(spark, "tokens")
    parts = TF.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                 path, PATH, 1, partitions=4).collect()
    assert len(parts) == 4 and max(p["n_docs"] for p in parts) < 200
    assert sorted(map(repr, read_back(spark, path))) == sorted(map(repr, expected(rows)))


def test_tasks_of_a_worker_share_what_they_met():
    spec = open(PATH, encoding="utf-8").read()
    first = TF.chunk_encoder(spec, np.dtype("<u2"))
    assert first.encode("Some words, Some WORDS") == OURS.encode("Some words, Some WORDS")
    again = TF.chunk_encoder(spec[:1] + spec[1:], np.dtype("<u2"))  # an equal text, as the next task unpacks it
    assert again is first and "WORDS" in again
