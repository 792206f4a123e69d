"""Language-model scoring over a sharded Elias-Fano n-gram trie.

Learning counts words, pairs and triples of all training documents in Spark, and
all of them are kept, those seen once too.  The number of shards follows the
number of tokens.  Probabilities are interpolated absolute
discounting: p(w|b,c) = max(n(bcw)-D,0)/n(bc) + rest(bc) p(w|c), p(w|c) the
same one order lower, p(w) add-one.  Every occurrence of a context that does not
end its text has a successor, so its rest is D x (different successors) / count:
only contexts seen twice or more need their number of successors, all others
leave D.  The discounted shares and the rests are stored as base-10 logarithms in
16 bits, rounded down, so no context gives out more than 1.  Tasks send counts of
pairs, triples and successors as packed sorted keys, one row a shard, and each
shard is merged and written by one task.

Texts are split once: `write_groups` stores the tokens of about 2 million at a
time as places in the list of their distinct words, whose hashes stand beside
them, and counting and scoring read these groups.

The trie is three levels of array files in the shared folder, memory-mapped by
the scoring tasks.  Level 1: word hashes (Elias-Fano; a word's id is its rank),
counts, and rest masses by id.  Levels 2 and 3 are split by a hash of (last
context word, word), so no frequent context makes a large shard.  Level 2: the
pairs as one monotone sequence, probability and rest mass of each.  Level 3:
for every pair of context words a node, and its successors in one monotone
sequence, kept as their ranks among the successors of the last context word,
above the node's place times the shard's largest number of successors: a lookup
searches the word there first, then its rank in the node.

Edge cases: null and empty texts are one end token; repeated rows count and
score each; a null doc_id is trained on and not held out; with no training
rows every token has probability 1 / (V + 1) with V = 0, that is 1; extra
columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import bounded_batches, pick, read_table, scratch, small_batches
from ridelens.llm.elias_fano import EliasFano, find, lower_bound, named, read_arrays, sequence, write_arrays
from ridelens.sources.io import drop_scratch

U64 = np.uint64
END_WORD = b"\n"  # no word holds a line end
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PAIR_LEAST, TRIPLE_LEAST, DISCOUNT = 1, 1, 0.75
FLUSH_TOKENS = 2_000_000
SHARD_TOKENS = 4_000_000  # a shard's pairs or triples are merged in memory
REST_BLOCK = 1 << 20
OPEN_FILES = 8
TASK_GROUPS = 2
MOST_SHORT = (1 << 16) - 1
STEP = 12 / 65535  # logarithms from -12 to 0 in 16 bits


def quantise(p: np.ndarray) -> np.ndarray:
    """Base-10 logarithms of probabilities, rounded down."""
    return np.ceil(np.clip(-np.log10(np.maximum(p, 1e-300)), 0, 12) / STEP - 1e-9).astype(np.uint16)


SEEN_ONCE = quantise(np.array(DISCOUNT))  # the rest of a context seen once


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * -STEP


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the sum of two numbers given by their log10."""
    ln10 = np.log(10.0)
    return np.log(np.exp(a * ln10) + np.exp(b * ln10)) / ln10


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shard_of(c: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (mix(c.astype(U64) * U64(0x9E3779B97F4A7C15) + w.astype(U64)) % U64(shards)).astype(np.int64)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each
    text has."""
    text = text.view(pa.large_string() if pa.types.is_large_binary(text.type) else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words = lists.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends leaves empty ones
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return words.filter(filled), np.diff(before[ends])


def number_tokens(words: list[pa.Array], lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The tokens of documents of so many tokens each (the end too) as places in
    the list of their distinct words; empties `words`."""
    together = pa.concat_arrays(words)
    words.clear()
    coded = together.dictionary_encode()
    distinct = [*coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), END_WORD]
    tokens = np.empty(int(lengths.sum()), np.int32)
    ends = np.zeros(len(tokens), bool)
    ends[np.cumsum(lengths) - 1] = True
    tokens[ends], tokens[~ends] = len(distinct) - 1, coded.indices.to_numpy()
    del together, coded
    pa.default_memory_pool().release_unused()
    return tokens, distinct


def split_groups(batches, most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[bytes]]]:
    """Other columns, token counts, tokens and distinct words of consecutive
    documents, about `most` tokens together."""
    rows, lengths, words, n = [], [], [], 0
    for batch in batches:
        for some in _slices(batch, most):
            found, counts = split_words(some.column("text"))
            rows.append(some.drop_columns(["text"]))
            lengths.append(counts + 1)
            words.append(found)
            n += int(lengths[-1].sum())
            if n >= most:
                yield pa.Table.from_batches(rows), np.concatenate(lengths), *number_tokens(words, np.concatenate(lengths))
                rows, lengths, n = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), np.concatenate(lengths), *number_tokens(words, np.concatenate(lengths))


def groups(batches, most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
    """`split_groups` with the doc_ids as a list."""
    for rows, lengths, tokens, words in split_groups(batches, most):
        yield rows.column("doc_id").to_pylist(), lengths, tokens, words


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


class Known:
    """What the model knows of a group's words, by their number."""

    def __init__(self, words: np.ndarray, trie: "Trie"):
        self.ids, self.counts = trie.ids(words)
        self.rest = np.zeros(len(words))
        known = self.ids >= 0
        self.rest[known] = trie.rest(self.ids[known])


def sliced(part: np.ndarray) -> tuple[dict[int, slice], np.ndarray]:
    """The order that brings equal parts together, and the slice of each part."""
    if len(part) and part.max() < 1 << 16:
        part = part.astype(np.uint16)  # sorted by radix
    order = np.argsort(part, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(part)]
    return {int(part[order[a]]): slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b}, order


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def first_marks(lengths: np.ndarray) -> np.ndarray:
    first = np.zeros(int(lengths.sum()), bool)
    first[starts(lengths)] = True
    return first


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, so that the shuffle's compression finds
    their empty high bytes side by side."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def blob(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row: sorted keys as differences, and their counts."""
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int64()),
        "keys": pa.array([pack(np.diff(keys, prepend=U64(0)))], pa.binary()),
        "counts": pa.array([pack(counts.astype(np.uint32))], pa.binary())})


BLOB = "shard long, keys binary, counts binary"


def merged_shards(batches, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards of a partition sorted by shard: their keys with summed counts of
    at least `least`."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None

    def done():
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        held.clear()
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        keep = total >= least
        return current, keys[first][keep], total[keep]
    for batch in batches:
        for row in range(batch.num_rows):
            shard = batch.column("shard")[row].as_py()
            if held and shard != current:
                yield done()
            current = shard
            held.append((np.cumsum(unpack(batch.column("keys")[row].as_py(), U64), dtype=U64),
                         unpack(batch.column("counts")[row].as_py(), np.uint32)))
    if held:
        yield done()


def short_counts(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in 16 bits; those that don't fit also apart, with their places."""
    large = np.flatnonzero(n >= MOST_SHORT)
    return {"n": np.minimum(n, MOST_SHORT).astype(np.uint16), "large": large, "large.n": n[large]}


def counts_at(arrays: dict[str, np.ndarray], place: np.ndarray) -> np.ndarray:
    n = arrays["n"][place].astype(np.int64)
    large = np.flatnonzero(n == MOST_SHORT)
    n[large] = arrays["large.n"][np.searchsorted(arrays["large"], place[large])]
    return n


class Store:
    """Array files of one folder: memory-mapped on a shared mount, else read.  The
    last few stay open, so a task never holds the whole model."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.fs, self.folder = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        else:
            self.fs, self.folder = pa.fs.LocalFileSystem(), path
        self.open: dict[str, dict[str, np.ndarray] | None] = {}

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Under a name of its own first, so a retried task replaces a whole file."""
        file = f"{self.folder}/{name}"
        self.fs.create_dir(file.rsplit("/", 1)[0], recursive=True)
        own = f"{file}.{np.random.SeedSequence().entropy:x}"
        with self.fs.open_output_stream(own) as f:
            write_arrays(f, arrays)
        self.fs.move(own, file)

    def read(self, name: str) -> dict[str, np.ndarray] | None:
        if name in self.open:
            self.open[name] = self.open.pop(name)  # the latest one
        else:
            while len(self.open) >= OPEN_FILES:
                self.open.pop(next(iter(self.open)))
            file = f"{self.folder}/{name}"
            if self.fs.get_file_info(file).type == pa.fs.FileType.NotFound:
                self.open[name] = None
            elif self.fs.type_name == "local":
                self.open[name] = read_arrays(np.asarray(np.memmap(file, np.uint8, "r")))
            else:
                with self.fs.open_input_file(file) as f:
                    self.open[name] = read_arrays(np.frombuffer(f.read(), np.uint8))
        return self.open[name]


@dataclass(frozen=True)
class Group:
    """Consecutive documents: their ids and token counts, whether the model learns
    from them, their tokens as numbers of words, and the hashes of the words."""
    doc_ids: pa.Array
    lengths: np.ndarray
    learned: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    @staticmethod
    def split(batches, most: int) -> Iterator["Group"]:
        """Groups of documents with columns doc_id, text and learned."""
        for rows, lengths, tokens, words in split_groups(batches, most):
            rows = rows.combine_chunks()
            yield Group(rows.column("doc_id").combine_chunks(), lengths,
                        rows.column("learned").to_numpy().astype(bool), tokens, hashes(words))

    def write(self, store: Store, name: str) -> None:
        packed = pa.compress(pack(self.tokens), "zstd", asbytes=True)
        store.write(name, {
            "doc_id": self.doc_ids.fill_null(0).to_numpy(), "null": self.doc_ids.is_null().to_numpy(zero_copy_only=False),
            "length": self.lengths, "learned": self.learned, "word": self.words,
            "token": np.frombuffer(packed, np.uint8)})

    @staticmethod
    def read(store: Store, name: str) -> "Group":
        a = store.read(name)
        lengths = np.asarray(a["length"])
        tokens = pa.decompress(a["token"].tobytes(), 4 * int(lengths.sum()), "zstd", asbytes=True)
        return Group(pa.array(np.asarray(a["doc_id"]), pa.int64(), mask=np.asarray(a["null"])), lengths,
                     np.asarray(a["learned"]), unpack(tokens, np.int32), np.asarray(a["word"]))

    def later(self) -> np.ndarray:
        """Places of the learned tokens that have a token before them."""
        return np.flatnonzero(np.repeat(self.learned, self.lengths) & ~first_marks(self.lengths))


@dataclass(frozen=True)
class Groups:
    """Groups stored below `path`, which the rows of `names` name."""
    names: DataFrame
    path: str

    def map(self, task, schema: str) -> DataFrame:
        """Rows of a function from an iterator of groups to record batches."""
        path = self.path

        def run(batches):
            store = Store(path)
            return task(Group.read(store, name) for b in batches for name in b.column("name").to_pylist())
        tasks = max(1, -(-self.names.count() // TASK_GROUPS))
        return self.names.repartition(tasks).mapInArrow(run, schema)


@dataclass(frozen=True)
class Shape:
    """What the tasks need to know of a model: its folder, the upper ends of
    the vocabulary shards (hashes), the first id of each, token and word
    totals, and the number of pair shards."""
    path: str
    ends: tuple[int, ...]
    bases: tuple[int, ...]
    tokens: int
    words: int
    shards: int


class Trie:
    def __init__(self, shape: Shape):
        self.shape, self.store = shape, Store(shape.path)
        self.ends = np.array(shape.ends, U64)

    def _sequence(self, file: str, name: str) -> EliasFano:
        return sequence(self.store.read(file), name)

    @staticmethod
    def _by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        slices, order = sliced(part)
        for k, some in slices.items():
            yield k, order[some]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and training counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for k, some in self._by(np.searchsorted(self.ends, hashes)):
            if k < len(self.ends):
                at = self._sequence(f"words/{k}", "hash").find(hashes[some])
                hit = at >= 0
                ids[some[hit]] = at[hit] + self.shape.bases[k]
                counts[some[hit]] = self.store.read(f"words/{k}")["count"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for k, some in self._by(np.searchsorted(np.array(self.shape.bases), ids, "right") - 1):
            out[some] = self.store.read(f"words/{k}")["count"][ids[some] - self.shape.bases[k]]
        return out

    def rest(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the mass a word leaves to shorter contexts."""
        out = np.full(len(ids), restore(SEEN_ONCE))
        for k, some in self._by(ids // REST_BLOCK):
            a = self.store.read(f"rest/{k}")
            if a is not None:
                out[some] = restore(a["rest"][ids[some] - k * REST_BLOCK])
        return out

    def key(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        return c.astype(U64) * U64(max(1, self.shape.words)) + w.astype(U64)

    def pairs(self, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each pair and its place there, -1 where it was never seen."""
        shard = shard_of(c, w, self.shape.shards)
        place = np.full(len(c), -1, np.int64)
        for k, some in self._by(shard):
            if self.store.read(f"pairs/{k}") is not None:
                place[some] = self._sequence(f"pairs/{k}", "key").find(self.key(c[some], w[some]))
        return shard, place

    def pair_counts(self, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each pair was seen, 0 where it never was."""
        out = np.zeros(len(place), np.int64)
        ok = np.flatnonzero(place >= 0)
        for k, some in self._by(shard[ok]):
            out[ok[some]] = counts_at(self.store.read(f"pairs/{k}"), place[ok[some]])
        return out

    def triples(self, k: int, c: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 of the discounted p(w|b,c) in shard k, -inf where never seen;
        `rank`: the pair (c, w)'s place among the successors of c there."""
        out = np.full(len(b), -np.inf)
        a = self.store.read(f"triples/{k}")
        if a is None or not len(b):
            return out
        keys = self.key(c, b)
        some = np.argsort(keys)
        node = self._sequence(f"triples/{k}", "node").find(keys[some])
        some, node = some[node >= 0], node[node >= 0]
        at = self._sequence(f"triples/{k}", "rank").find(node.astype(U64) * a["stride"] + rank[some].astype(U64))
        out[some[at >= 0]] = restore(a["p"][at[at >= 0]])
        return out

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.shape.tokens + self.shape.words + 1))

    def score(self, tokens: np.ndarray, first: np.ndarray, known: Known) -> np.ndarray:
        """log10 probability of every token; `first` marks documents' first ones."""
        ids, one = known.ids[tokens], self.log_unigram(known.counts)[tokens]
        out = one
        context = np.flatnonzero(~first).astype(np.int32)  # tokens with a word before them
        context = context[ids[context - 1] >= 0]
        out[context] += known.rest[tokens[context - 1]]
        both = context[ids[context] >= 0]
        unique, slot = np.unique(self.key(ids[both - 1], ids[both]), return_inverse=True)
        words = U64(max(1, self.shape.words))
        shard = shard_of(unique // words, unique % words, self.shape.shards)
        slices, order = sliced(shard)  # from here on a shard's pairs stand together, still ascending
        unique, back = unique[order], np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        slot, shard = back[slot], shard[order]
        which = np.full(len(ids), -1, np.int32)  # each token's pair
        which[both] = slot
        deep = both[~first[both - 1]]  # tokens with two words before them
        deep = deep[which[deep - 1] >= 0]
        deep_slices, order = sliced(shard[which[deep]])
        deep = deep[order]
        c = (unique // words).astype(np.int64)
        direct, rest = np.full(len(unique), -np.inf), np.zeros(len(unique))
        longest = np.full(len(ids), -np.inf)
        # a pair's shard holds its triples too: each shard is decoded once
        for k, some in slices.items():
            a = self.store.read(f"pairs/{k}")
            if a is None:
                continue
            pairs = self._sequence(f"pairs/{k}", "key").opened(some.stop - some.start)
            place = find(pairs, unique[some])
            seen = place >= 0
            direct[some][seen] = restore(a["p"][place[seen]])
            rests = self.store.read(f"pair-rest/{k}")
            rest[some][seen] = restore(SEEN_ONCE) if rests is None else restore(rests["rest"][place[seen]])
            if k in deep_slices:
                heads = c[some][seen]  # ascending
                new = np.diff(heads, prepend=-1) != 0
                start = lower_bound(pairs, self.key(heads[new], np.zeros(int(new.sum()), np.int64)))
                rank = np.full(len(place), -1, np.int64)
                rank[seen] = place[seen] - start[np.cumsum(new) - 1]
                at = deep[deep_slices[k]]
                own = which[at] - some.start
                at, own = at[rank[own] >= 0], own[rank[own] >= 0]
                longest[at] = self.triples(k, c[some][own], ids[at - 2], rank[own])
        hit = both[np.isfinite(direct[slot])]
        out[hit] = log_sum(direct[which[hit]], out[hit])
        out[deep] += rest[which[deep - 1]]  # 0 where the context was never seen
        # the last of three words need not follow a known second: its context counts alone
        only = context[(ids[context] < 0) & ~first[context - 1]]
        only = only[which[only - 1] >= 0]
        out[only] += rest[which[only - 1]]
        hit = np.flatnonzero(np.isfinite(longest))
        out[hit] = log_sum(longest[hit], out[hit])
        return out


def write_groups(docs: DataFrame) -> Groups:
    """Split the texts of doc_id, text, learned (boolean) once.  A group's name is
    its task attempt's own, so a retried task's rows name only its own files."""
    spark = docs.sparkSession
    path, names = scratch(spark, "ngram-groups"), scratch(spark, "ngram-group-names")

    def write(batches):
        store = Store(path)
        for group in Group.split(batches, FLUSH_TOKENS):
            name = f"groups/{uuid.uuid4().hex}"
            group.write(store, name)
            yield pa.RecordBatch.from_pydict({"name": pa.array([name])})
    (pick(docs, doc_id="long", text="binary", learned="boolean").mapInArrow(write, "name string").write.parquet(names))
    return Groups(spark.read.schema("name string").parquet(names), path)


def count_words(groups: Groups) -> DataFrame:
    """hash (as a signed long in unsigned order), n."""
    def count(found):
        for group in found:
            n = np.bincount(group.tokens[np.repeat(group.learned, group.lengths)], minlength=len(group.words))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array((group.words[met] ^ U64(1 << 63)).view(np.int64)), "n": pa.array(n[met])})
    return groups.map(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def write_words(groups: Groups, path: str, parts: int, shards: int) -> Shape:
    """Level 1 files by hash range; returns the shape of the model, with `shards`
    pair shards at least."""
    def write(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy().view(U64) ^ U64(1 << 63)
            k, counts = TaskContext.get().partitionId(), t.column("n").to_numpy()
            Store(path).write(f"words/{k}", {**named("hash", h), "count": counts})
            yield pa.RecordBatch.from_pydict({
                "k": pa.array([k]), "last": pa.array([str(int(h[-1]))]), "words": pa.array([len(h)]),
                "tokens": pa.array([int(counts.sum())])})

    spark = groups.names.sparkSession
    counts = scratch(spark, "word-counts")
    count_words(groups).write.parquet(counts)
    rows = (spark.read.schema("h long, n long").parquet(counts).repartitionByRange(parts, "h").sortWithinPartitions("h")
            .mapInArrow(write, "k long, last string, words long, tokens long").collect())  # one row a shard
    drop_scratch(spark, counts)  # its only reader is done
    rows = sorted(rows)
    store = Store(path)
    for place, r in enumerate(rows):  # empty ranges leave no file: close the gaps
        if place != r["k"]:
            store.fs.move(f"{store.folder}/words/{r['k']}", f"{store.folder}/words/{place}")
    bases = np.cumsum([0, *(r["words"] for r in rows)]).tolist()
    tokens = sum(r["tokens"] for r in rows)
    return Shape(path, tuple(int(r["last"]) for r in rows), tuple(bases[:-1]),
                 tokens, bases[-1], max(shards, -(-tokens // SHARD_TOKENS)))


def _by_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


def _finish(rows: DataFrame, shards: int, write) -> None:
    """Bring successor counts to their shards and write them there."""
    _by_shard(rows, shards).mapInArrow(write, "shard long").write.format("noop").mode("overwrite").save()


def write_pairs(groups: Groups, shape: Shape) -> None:
    """Level 2: the pairs, and the rest of each word as a context (level 1), in
    blocks of REST_BLOCK ids."""
    words = U64(max(1, shape.words))

    def count(found):
        trie = Trie(shape)
        for group in found:
            ids = trie.ids(group.words)[0][group.tokens]
            at = group.later()
            keys, n = np.unique(trie.key(ids[at - 1], ids[at]), return_counts=True)
            shard = shard_of(keys // words, keys % words, shape.shards)
            for k, some in Trie._by(shard):
                yield blob(k, keys[some], n[some])

    def write(batches):
        """Successors in the shard of the words seen twice or more, by block."""
        trie = Trie(shape)
        for shard, keys, n in merged_shards(batches, PAIR_LEAST):
            c = (keys // words).astype(np.int64)
            seen = trie.counts(c)
            trie.store.write(f"pairs/{shard}", {
                **named("key", keys), "p": quantise((n - DISCOUNT) / seen), **short_counts(n)})
            heads, successors = np.unique(c[seen > 1], return_counts=True)
            for block, some in Trie._by(heads // REST_BLOCK):
                yield blob(block, (heads[some] - block * REST_BLOCK).astype(U64), successors[some])

    def write_rests(batches):
        trie = Trie(shape)
        for block, places, successors in merged_shards(batches, 1):
            ids = places.astype(np.int64) + block * REST_BLOCK
            rest = np.full(REST_BLOCK, SEEN_ONCE)
            rest[places.astype(np.int64)] = quantise(DISCOUNT * successors / trie.counts(ids))
            trie.store.write(f"rest/{block}", {"rest": rest})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([block])})

    counted = groups.map(count, BLOB)
    _finish(_by_shard(counted, shape.shards).mapInArrow(write, BLOB), max(1, -(-shape.words // REST_BLOCK)), write_rests)


def write_triples(groups: Groups, shape: Shape) -> None:
    """Level 3: the triples, and the rest of each pair as a context, beside
    level 2."""
    words = U64(max(1, shape.words))

    def count(found):
        trie = Trie(shape)
        for group in found:
            ids = trie.ids(group.words)[0][group.tokens]
            first, at = first_marks(group.lengths), group.later()
            keys = trie.key(ids[at - 1], ids[at])
            pairs, slot = np.unique(keys, return_inverse=True)
            shard, place = trie.pairs((pairs // words).astype(np.int64), (pairs % words).astype(np.int64))
            which = np.full(len(ids), -1, np.int64)
            which[at] = np.where(place[slot] >= 0, slot, -1)
            ends = at[(which[at] >= 0) & (which[at - 1] >= 0)]
            ends = ends[~first[ends - 1]]
            pair = which[ends]
            for k, some in Trie._by(shard[pair]):
                key = place[pair[some]].astype(U64) * words + ids[ends[some] - 2].astype(U64)
                yield blob(k, *np.unique(key, return_counts=True))

    def write(batches):
        """Successors in the shard of the pairs seen twice or more, by their
        place in their own shard."""
        trie = Trie(shape)
        for shard, keys, n in merged_shards(batches, TRIPLE_LEAST):
            if not len(keys):
                continue
            place, b = (keys // words).astype(np.int64), (keys % words).astype(np.int64)
            del keys
            pairs = trie._sequence(f"pairs/{shard}", "key").values()
            c = (pairs[place] // words).astype(np.int64)
            start = np.searchsorted(pairs, trie.key(c, np.zeros(len(c), np.int64)))
            stride = U64((np.searchsorted(pairs, trie.key(c + 1, np.zeros(len(c), np.int64))) - start).max())
            place -= start  # the rank among the successors of the last context word
            node, which = np.unique(trie.key(c, b), return_inverse=True)
            del pairs, b, c, start
            own, at = trie.pairs((node % words).astype(np.int64), (node // words).astype(np.int64))
            seen = trie.pair_counts(own, at)
            rank = which.astype(U64) * stride + place.astype(U64)
            del place
            order = np.argsort(rank)
            trie.store.write(f"triples/{shard}", {
                **named("node", node), **named("rank", rank[order]), "stride": np.array([stride]),
                "p": quantise((n - DISCOUNT) / seen[which])[order]})
            successors, twice = np.bincount(which, minlength=len(node)), np.flatnonzero(seen > 1)
            for k, some in Trie._by(own[twice]):
                some = twice[some]
                some = some[np.argsort(at[some])]
                yield blob(k, at[some].astype(U64), successors[some])

    def write_rests(batches):
        trie = Trie(shape)
        for shard, places, successors in merged_shards(batches, 1):
            pairs, places = trie.store.read(f"pairs/{shard}"), places.astype(np.int64)
            rest = np.full(len(pairs["n"]), SEEN_ONCE)
            rest[places] = quantise(DISCOUNT * successors / counts_at(pairs, places))
            trie.store.write(f"pair-rest/{shard}", {"rest": rest})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard])})

    counted = groups.map(count, BLOB)
    _finish(_by_shard(counted, shape.shards).mapInArrow(write, BLOB), shape.shards, write_rests)


def learn_groups(groups: Groups, shards: int | None = None) -> Shape:
    """Count the learned documents of all groups and write the trie; returns its
    shape."""
    spark = groups.names.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, 64):  # rows of packed keys
        shape = write_words(groups, scratch(spark, "ngram-trie"), n, n)
        write_pairs(groups, shape)
        write_triples(groups, shape)
    return shape


def learn(docs: DataFrame, shards: int | None = None) -> Shape:
    """Count all rows of `docs` and write the trie; returns its shape."""
    spark = docs.sparkSession
    with small_batches(spark, 64):
        groups = write_groups(docs.withColumn("learned", F.lit(True)))
    shape = learn_groups(groups, shards)
    drop_scratch(spark, groups.path)  # its readers are done
    return shape


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored(found: Iterator[Group], shape: Shape) -> Iterator[pa.RecordBatch]:
    trie = Trie(shape)
    for group in found:
        known = Known(group.words, trie)
        at, counts = starts(group.lengths), known.counts[group.tokens]
        yield pa.RecordBatch.from_pydict({
            "doc_id": group.doc_ids,
            "n_tokens": pa.array(group.lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)),
            "base_score": pa.array(np.add.reduceat(trie.log_unigram(known.counts)[group.tokens], at)),
            "score": pa.array(np.add.reduceat(trie.score(group.tokens, first_marks(group.lengths), known), at))})


def score(docs: DataFrame, shape: Shape) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    bounded_batches(docs.sparkSession)
    return (pick(docs.withColumn("learned", F.lit(False)), doc_id="long", text="binary", learned="boolean")
            .mapInArrow(lambda batches: scored(Group.split(batches, FLUSH_TOKENS), shape), SCORES))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def op3_ngram_score(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with small_batches(spark, 64):
        groups = write_groups(docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("learned")))
    shape = learn_groups(groups)
    return groups.map(lambda found: scored(found, shape), SCORES).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(shape.tokens).cast("long").alias("train_tokens"), "base_score", "score")
