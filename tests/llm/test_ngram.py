import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.llm import elias_fano as E
from ridelens.llm import ngram_model as M


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 300), max_size=300, unique=True),
       st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 300), max_size=50))
def test_elias_fano(values, others):
    import io
    v = np.array(sorted(values), np.uint64)
    f = io.BytesIO()
    E.write_arrays(f, E.named("x", v))
    s = E.sequence(E.read_arrays(np.frombuffer(f.getvalue(), np.uint8)), "x")
    keys = np.array([*values, *others], np.uint64)
    place = {int(x): k for k, x in enumerate(v)}
    for many in (True, False):  # decoding everything, and searching each key
        s._many = lambda n, many=many: many
        assert s.find(keys).tolist() == [place.get(int(k), -1) for k in keys]
        assert s.lower_bound(keys).tolist() == np.searchsorted(v, keys).tolist()
        assert (s.get(np.arange(len(v))) == v).all()


def tokens(text):
    return (text or "").encode().translate(M.LOWER).split() + [None]


class Brute:
    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.one = Counter(w for d in docs for w in d)
        two = Counter(p for d in docs for p in zip(d, d[1:]))
        three = Counter(p for d in docs for p in zip(d, d[1:], d[2:]))
        self.two = {k: v for k, v in two.items() if v >= M.PAIR_LEAST}
        self.three = {k: v for k, v in three.items() if v >= M.TRIPLE_LEAST}
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.m1, self.m2 = Counter(), Counter()
        for (c, _), k in self.two.items():
            self.m1[c] += k - M.DISCOUNT
        for (b, c, _), k in self.three.items():
            self.m2[b, c] += k - M.DISCOUNT

    def p1(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p2(self, c, w):
        if c not in self.one:
            return self.p1(w)
        n = self.one[c]
        return max(self.two.get((c, w), 0) - M.DISCOUNT, 0) / n + (1 - self.m1[c] / n) * self.p1(w)

    def p3(self, b, c, w):
        if (b, c) not in self.two:
            return self.p2(c, w)
        n = self.two[b, c]
        return max(self.three.get((b, c, w), 0) - M.DISCOUNT, 0) / n + (1 - self.m2[b, c] / n) * self.p2(c, w)

    def score(self, text):
        d = tokens(text)
        return sum(math.log10(self.p1(w) if k == 0 else self.p2(d[0], w) if k == 1 else self.p3(d[k - 2], d[k - 1], w))
                   for k, w in enumerate(d))


def close(got, brute, rows):
    want = sorted((repr(i), len(tokens(t)), sum(brute.one[w] > 0 for w in tokens(t)),
                   sum(math.log10(brute.p1(w)) for w in tokens(t)), brute.score(t)) for i, t in rows)
    have = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have):
        assert a[:3] == b[:3]
        assert abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) <= 4 * M.STEP * a[1]


def test_query_equals_brute_force_and_beats_the_base(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    brute = Brute([t for (_, t), o in zip(rows, out) if not o])
    got = M.op3_ngram_score(spark, d).collect()
    close(got, brute, rows)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for (i, _), o in zip(rows, out) if o}
    assert {r["train_tokens"] for r in got} == {brute.n}
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    shape = M.learn(odd_docs, shards=3)
    close(M.score(odd_docs, shape).collect(), Brute([t for _, t in odd_rows]), odd_rows)
    assert M.score(no_docs, shape).count() == 0
    nothing = M.learn(no_docs, shards=2)
    assert all(r["score"] == 0 for r in M.score(odd_docs, nothing).collect())


def test_what_was_seen_once_counts(spark):
    seen, unseen = "red green blue", "red blue green"
    docs = spark.createDataFrame([(1, seen)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in M.score(
        spark.createDataFrame([(1, seen), (2, unseen)], "doc_id long, text string"), M.learn(docs, shards=2)).collect()}
    # n = v = 4: p1 = 2 / 9, p2 = 1/4 + 3/4 p1 = 5/12, p3 = 1/4 + 3/4 p2 = 9/16
    assert abs(got[1] - math.log10(2 / 9 * 5 / 12 * 9 / 16 * 9 / 16)) < 16 * M.STEP
    assert got[1] > got[2] + 0.5


def test_more_tokens_make_more_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 100)
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(60))) for i in range(20)]
    shape = M.learn(spark.createDataFrame(rows, "doc_id long, text string"), shards=2)
    assert shape.shards == -(-shape.tokens // 100) > 2
    close(M.score(spark.createDataFrame(rows, "doc_id long, text string"), shape).collect(),
          Brute([t for _, t in rows]), rows)


def test_words_split_as_python_splits_them():
    import pyarrow as pa
    texts = ["", None, "  A b\tc\x0bd\x0ce\r\n f ", "x\x1cy \x85z", "Éa É B", "\n\n", "one one"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(6), None], pa.int64()), "text": pa.array(
        [None if t is None else t.encode() for t in texts], pa.binary())})
    for most in (1, 3, 1000):
        found = []
        for ids, lengths, numbers, words in M.groups([batch, batch.slice(2, 2)], most):
            parts = np.split(numbers, np.cumsum(lengths)[:-1])
            found += [(i, [words[n] for n in part]) for i, part in zip(ids, parts)]
        want = [(i, (t or "").encode().translate(M.LOWER).split() + [M.END_WORD]) for i, t in zip([*range(6), None], texts)]
        assert found == want + want[2:4]


def test_counts_above_16_bits():
    n = np.array([1, 65534, 65535, 65536, 2, 1 << 40])
    assert M.counts_at(M.short_counts(n), np.array([5, 0, 2, 3, 1, 4])).tolist() == n[[5, 0, 2, 3, 1, 4]].tolist()


def test_a_task_keeps_few_files_of_the_model_open(tmp_path):
    store = M.Store(str(tmp_path))
    for k in range(40):
        store.write(f"pairs/{k}", {"n": np.array([k])})
    assert [int(store.read(f"pairs/{k}")["n"][0]) for k in (*range(40), 3)] == [*range(40), 3]
    assert len(store.open) <= M.OPEN_FILES and store.read("pairs/99") is None


def test_low_parts_need_no_packing_up_to_32_bits():
    for top in (1 << 12, 1 << 20, 1 << 34, 1 << 60):
        v = np.unique(np.random.default_rng(1).integers(0, top, 500, dtype=np.uint64))
        a = E.named("x", v)
        width = int(a["x.meta"][1])
        assert width in (0, 16, 32) and a["x.low"].itemsize * 8 == width or width > 32 and a["x.low"].dtype == np.uint64
        s = E.sequence(a, "x")
        assert (s.values() == v).all() and (E.find(s.opened(0), v) == E.find(s.values(), v)).all()


def test_texts_are_split_once_and_groups_suffice(spark, odd_docs, odd_rows, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "documents")
    odd_docs.withColumn("learned", ~M.held_out(F.col("doc_id"))).write.parquet(path)
    groups = M.write_groups(spark.read.parquet(path))
    for file in (tmp_path / "documents").glob("*.parquet"):
        file.write_bytes(b"")  # neither learning nor scoring reads a text again
    shape = M.learn_groups(groups, shards=3)
    got = groups.map(lambda found: M.scored(found, shape), M.SCORES).collect()
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in odd_rows]
    assert any(out) and not all(out)
    close(got, Brute([t for (_, t), o in zip(odd_rows, out) if not o]), odd_rows)


def test_a_group_is_read_as_it_was_written(tmp_path):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([7, None, -1], pa.int64()), "text": pa.array([b"a B a", None, b"c " * 300], pa.binary()),
        "learned": pa.array([True, False, True])})
    store = M.Store(str(tmp_path))
    group, = M.Group.split([batch], 1000)
    group.write(store, "groups/x")
    read = M.Group.read(store, "groups/x")
    assert read.doc_ids.to_pylist() == [7, None, -1] and read.lengths.tolist() == [4, 1, 301]
    assert read.learned.tolist() == [True, False, True]
    assert (read.tokens == group.tokens).all() and (read.words == M.hashes([b"a", b"b", b"c", M.END_WORD])).all()
    assert read.later().tolist() == [1, 2, 3, *range(6, 306)]
