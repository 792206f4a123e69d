"""Byte-level BPE encoding and decoding with numpy merge rounds.

Texts are split by the tokenizer's pattern; each distinct piece is encoded
once per cache.  Pieces are laid out in padded matrices bucketed by length;
in each round every row merges its leftmost pair of minimum rank, found by
hashed lookup of token pairs, and is compacted by one column.  Rows without a
mergeable pair leave the matrix.  A piece above `MATRIX_BYTES` bytes (for
example a megabyte without a space) takes a heap over the same pairs, since
rounds over a row cost the square of its length; the result is the same.

Edge cases: null and empty texts have no ids and decode to no bytes; any text
decodes to its own UTF-8 bytes; repeated rows are encoded one by one; extra
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import bounded_batches, pick, read_table

NONE = np.uint32(0xFFFFFFFF)
MATRIX_BYTES = 512
CACHE_PIECES = 300_000
GROUP_CHARS = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t}


class PairTable:
    """Open-addressing hash table: (left id, right id) -> merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, NONE, np.uint32)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # of the keys that want one free slot, the last written wins it
            free = self.keys[slot[todo]] == empty
            at = todo[free]
            self.keys[slot[at]] = keys[at]
            won = at[self.keys[slot[at]] == keys[at]]
            self.values[slot[won]] = merged[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair is no token (or a side is NONE)."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slot = self._home(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out.reshape(shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        rows = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items()
                for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        triples = np.array(rows, np.uint32).reshape(-1, 3)
        self.pairs = PairTable(triples[:, 0], triples[:, 1], triples[:, 2])
        self.cache: dict[str, tuple[int, ...]] = {}

    def _merge_rows(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """Rows of ids padded with NONE at the right, merged to the end."""
        done: list = [()] * len(ids)
        row = np.arange(len(ids))
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost minimum
            least = rank[np.arange(len(row)), at]
            over = least == NONE
            if over.any():
                for r, x in zip(row[over].tolist(), ids[over].tolist()):
                    done[r] = tuple(v for v in x if v != 0xFFFFFFFF)
                ids, rank, row, at, least = ids[~over], rank[~over], row[~over], at[~over], least[~over]
                if not len(row):
                    break
            n, width = np.arange(len(row)), ids.shape[1]
            ids[n, at] = least
            keep = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, keep, axis=1)
            if width == 2:
                for r, x in zip(row.tolist(), ids[:, 0].tolist()):
                    done[r] = (x,)
                break
            keep = np.arange(width - 2) + (np.arange(width - 2) >= at[:, None])
            rank = np.take_along_axis(rank, np.minimum(keep, width - 2), axis=1)
            before, after = at > 0, at < width - 2
            rank[n[before], at[before] - 1] = self.pairs.get(
                ids[n[before], at[before] - 1], ids[n[before], at[before]])
            rank[n[after], at[after]] = self.pairs.get(
                ids[n[after], at[after]], ids[n[after], at[after] + 1])
        return done

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        part = [piece[i:i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i) for i in range(len(part) - 1)
                if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= len(part) or self.ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(part):
                    r = self.ranks.get(part[a] + part[b])
                    if r is not None:
                        heapq.heappush(heap, (r, a))
        return tuple(self.ranks[p] for p in part if p is not None)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        raw = [p.encode("utf-8") for p in pieces]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(raw):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = (whole,)
            elif len(p) > MATRIX_BYTES:
                out[k] = self._merge_long(p)
            else:
                buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(k)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for s in range(0, len(members), step):
                part = members[s:s + step]
                ids = np.full((len(part), width), NONE, np.uint32)
                lengths = np.array([len(raw[k]) for k in part])
                ids[np.arange(width) < lengths[:, None]] = self.byte_ids[
                    np.frombuffer(b"".join(raw[k] for k in part), np.uint8)]
                for k, merged in zip(part, self._merge_rows(ids)):
                    out[k] = merged
        return out

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        cache = self.cache
        missing = {p for s in split for p in s if p not in cache}
        if len(cache) + len(missing) > CACHE_PIECES:
            cache.clear()
            missing = {p for s in split for p in s}
        todo = list(missing)
        cache.update(zip(todo, self.encode_pieces(todo)))
        return [list(chain.from_iterable(map(cache.__getitem__, s))) for s in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def grouped(texts: Iterable[str], most_chars: int = GROUP_CHARS):
    """Consecutive texts in lists of about `most_chars` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most_chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with `decoded` also the bytes that the ids give back.
    The vocabulary file is read here and travels with the job: its size is
    fixed, whatever the documents."""
    bounded_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)

    def encode(batches):
        codec = Codec(ranks, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = (t.as_py() or "" for t in batch.column("text"))
            start = 0
            for group in grouped(texts):
                ids = codec.encode(group)
                cols = {"doc_id": doc_ids.slice(start, len(ids)), "ids": pa.array(ids, pa.list_(pa.int32()))}
                if decoded:
                    cols["decoded"] = pa.array([codec.decode(i) for i in ids], pa.binary())
                start += len(ids)
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return pick(docs, doc_id="long", text="string").mapInArrow(encode, schema)


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, decoded binary of rows with `ids`; null ids decode to no bytes."""
    bounded_batches(encoded.sparkSession)
    token = {i: t for t, i in read_ranks(ranks_path).items()}

    def decode(batches):
        for batch in batches:
            raw = [b"".join(map(token.__getitem__, x or ())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "decoded": pa.array(raw, pa.binary())})
    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(decode, "doc_id long, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    ids = F.transform("ids", lambda i: i.cast("string"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def _public_bpe() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(read_table(spark, sf_dir, "documents"), *_public_bpe(), decoded=True))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return digests(bpe_encode(docs, *_public_bpe(), decoded=True), "ids")
