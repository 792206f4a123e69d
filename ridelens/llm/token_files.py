"""Token ids as flat binary files.

Layout of a dataset folder: for every part `<name>.ids` (unsigned integers,
little endian, one after the other), `<name>.offsets` (uint64: where each
document starts inside the part, and the end) and `<name>.docs` (int64
doc_ids).  Parts are ranges of ascending doc_id; a part's base, the prefix sum
of the lengths of the parts before it, turns its offsets into global ones.
The table of parts is returned by the writer and stored as `parts`.

Tasks write under names of their own attempt, and only names that a finished
task returned enter the table of parts, so retried tasks do no harm.  Files of
a shared mount are memory-mapped by the reader; in another store the reader
fetches one part at a time.

Edge cases: a null or empty text has only the end id; rows with equal doc_id
stand in the order of their texts; rows with a null doc_id come first; an
empty table gives no parts and no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from array import array as pack
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.common import bounded_batches, pick, read_table, scratch

MARKS = ".,;:!?"
SPECIAL = "<|"
CACHE_CHUNKS = 800_000
PART_SCHEMA = "part int, name string, n_docs long, n_tokens long"


def byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte:
    itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


BYTE_CHARS = byte_chars()


class ChunkEncoder(dict):
    """Packed ids of the chunks of a text between spaces and line ends, encoded
    on first use.  A chunk is taken apart into its word and the sentence marks
    behind it (always pieces of their own), ASCII capitals are lowered (as the
    tokenizer does), and only words not seen before go through the library:
    words of letters alone are one piece and, normalised here, go straight to
    its model; others take its whole path.  A chunk with the beginning of a
    special token goes to the library as it stands, which finds special tokens
    before it lowers.  Right for lower-casing tokenizers whose pieces never hold
    white space and whose special tokens begin with `SPECIAL`."""

    def __init__(self, tokenizer_json: str, dtype: np.dtype):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.code = "H" if dtype.itemsize == 2 else "I"  # little endian, as Spark's platforms are
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            low = "".join(c.lower() for c in word) if "Σ" in word else word.lower()  # letter by letter
            if low.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
                packed = self._piece(low if low.isascii() else "".join(map(BYTE_CHARS.__getitem__, low.encode())))
            else:
                packed = pack(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            self.words[word] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        return pack(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii():  # most chunks: one piece, nothing to take apart
            low = chunk.lower()
            packed = self.words.get(low)
            if packed is None:
                packed = self.words[low] = self._piece(low)
            self[chunk] = packed
            return packed
        if not chunk:  # between two white spaces
            self[chunk] = b""
            return b""
        word = chunk.rstrip(MARKS)
        if SPECIAL in chunk:
            packed = pack(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        elif len(word) < len(chunk):
            if word and unicodedata.normalize("NFC", word[-1]).lower()[-1].isalnum():
                packed = self[word] + self._word(chunk[len(word):])
            else:
                packed = self._word(chunk)
        else:
            packed = self._word(chunk.lower() if chunk.isascii() else chunk)
        self[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_CHUNKS:
            self.clear()
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def chunk_encoder(tokenizer_json: str, dtype: np.dtype) -> ChunkEncoder:
    """One for all tasks of a Python worker: what it has met serves the next task."""
    return ChunkEncoder(tokenizer_json, dtype)


def open_store(path: str):
    """(file system, path inside it) of a URI or a plain path."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      partitions: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the table of
    parts with their bases."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # a vocabulary file: its size does not grow with the documents
    from tokenizers import Tokenizer
    ids_type = np.dtype("<u2" if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else "<u4")

    def write(batches):
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        encoder, name = chunk_encoder(spec, ids_type), f"part-{uuid.uuid4().hex}"
        starts, n_docs, end = 0, 0, np.array([end_id], ids_type).tobytes()
        with store.open_output_stream(f"{folder}/{name}.ids") as ids_out, \
                store.open_output_stream(f"{folder}/{name}.offsets") as offsets_out, \
                store.open_output_stream(f"{folder}/{name}.docs") as docs_out:
            offsets_out.write(np.uint64(0).tobytes())
            for batch in batches:
                doc_ids, ends = batch.column("doc_id").to_pylist(), []
                for text in batch.column("text"):
                    ids = encoder.encode(text.as_py() or "") + end
                    ids_out.write(ids)
                    starts += len(ids) // len(end)
                    ends.append(starts)
                n_docs += len(ends)
                offsets_out.write(np.array(ends, "<u8").tobytes())
                docs_out.write(np.array([NULL_DOC if d is None else d for d in doc_ids], "<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": TaskContext.get().partitionId(), "name": name, "n_docs": n_docs, "n_tokens": starts}],
            schema=pa.schema([("part", pa.int32()), ("name", pa.string()),
                              ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that share an id (or have none) are split by how their texts begin
    written = (pick(docs, doc_id="long", text="string")
               .repartitionByRange(n, "doc_id", F.substring("text", 1, 64))
               .sortWithinPartitions("doc_id", "text").mapInArrow(write, PART_SCHEMA))
    # one row per part: their number is that of the partitions, not of the documents
    rows = sorted(r for r in written.collect() if r["n_docs"])
    bases = [0, *accumulate(r["n_tokens"] for r in rows)]
    parts = spark.createDataFrame(
        [(k, r["name"], r["n_docs"], r["n_tokens"], bases[k], ids_type.itemsize)
         for k, r in enumerate(rows)], PART_SCHEMA + ", base long, width int")
    parts.write.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/parts")


NULL_DOC = -(1 << 63)  # stands for a null doc_id in the files


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (global), n_tokens and ids (binary: little-endian uint32)."""
    parts = spark.read.parquet(f"{path}/parts")

    def read(batches):
        store, folder = open_store(path)

        def load(file: str, dtype: str) -> np.ndarray:
            if store.type_name == "local":
                return np.memmap(file, dtype, "r")
            with store.open_input_file(file) as f:
                return np.frombuffer(f.read(), dtype)

        for part in chain.from_iterable(b.to_pylist() for b in batches):
            file = f"{folder}/{part['name']}"
            ids = load(f"{file}.ids", f"<u{part['width']}")
            offsets, doc_ids = load(f"{file}.offsets", "<u8"), load(f"{file}.docs", "<i8")
            done = 0
            while done < len(doc_ids):  # batches of about a million ids
                upto = int(np.searchsorted(offsets, offsets[done] + np.uint64(1 << 20), "left"))
                upto = min(max(upto, done + 1), len(doc_ids))
                bounds = offsets[done:upto + 1].astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if d == NULL_DOC else d for d in doc_ids[done:upto].tolist()],
                                       pa.int64()),
                    "start": pa.array(bounds[:-1] + part["base"]),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "ids": pa.array([ids[a:b].astype("<u4").tobytes()
                                     for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})
                done = upto

    n = max(1, parts.count())  # parts, one task each
    return (parts.repartition(n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary"))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = scratch(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path,
                      public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
