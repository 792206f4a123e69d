import random
from collections import defaultdict

from pyspark.sql import functions as F

from ridelens.llm import line_dedup as L


def brute(rows, digest, min_words=L.MIN_WORDS):
    """Texts after removal, by the operator's rules on plain dictionaries."""
    info, places = {}, defaultdict(list)
    for key in set(rows):
        lines = key[1].encode().split(b"\n")
        chunks = L.line_chunks(lines, min_words)
        info[key] = lines, chunks
        for k, (_, c) in enumerate(chunks):
            if any(w for _, w in c):
                places[tuple(h for h, _ in c)].append((key, k))

    def equal(a, b, i, j, step):
        n = total = 0
        while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j] and total <= min_words:
            total += len(a[i].split())
            i, j, n = i + step, j + step, n + 1
        return n
    gone = defaultdict(set)
    for found in places.values():
        first, f = min(found, key=lambda x: (x[0][0], digest[x[0]], x[1]))
        for key, k in found:
            if (key, k) != (first, f):
                (lines, chunks), (lines1, chunks1) = info[key], info[first]
                start, n, start1 = chunks[k][0], len(chunks[k][1]), chunks1[f][0]
                a = start - equal(lines, lines1, start - 1, start1 - 1, -1)
                b = start + n + equal(lines, lines1, start + n, start1 + n, 1)
                if sum(len(x.split()) for x in lines[a:b]) > min_words:
                    gone[key].update(range(a, b))
    return {k: b"\n".join(x for i, x in enumerate(info[k][0]) if i not in gone[k]).decode() for k in info}


def corpus(seed=4, docs=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))
    short, passages = "Licensed under X", ["\n".join(line(n) for n in (22, 9, 30, 14)) for _ in range(8)]
    passages += [line(60) for _ in range(8)]
    rows = []
    for i in range(docs):
        lines = [line(rng.choice([0, 3, 9, 25, 55])) for _ in range(rng.choice([1, 5, 20]))]
        if i % 3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(passages))
        lines.insert(rng.randrange(len(lines) + 1), short)
        rows.append((i, "\n".join(lines)))
    return rows, passages, short


def test_equals_brute_force_and_keeps_one_copy(spark):
    rows, passages, short = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    digest = {(r["doc_id"], r["text"]): r["d"] for r in df.withColumn("d", F.xxhash64("text")).collect()}
    got = {r["doc_id"]: r["text"] for r in L.remove_passages(df).collect()}
    want = brute(rows, digest)
    assert got == {k[0]: t for k, t in want.items()}
    everything = "\n\n".join(got[i] for i, _ in rows)
    assert all(everything.count(p) == 1 for p in passages if sum(p in t for _, t in rows))
    assert all(got[i] == t for i, t in rows if not any(p in t for p in passages))


def test_boundaries_resist_shifts():
    rng = random.Random(8)
    lines = [" ".join(["w"] * rng.randrange(1, 20) + [str(rng.random())]).encode() for _ in range(200)]
    ends = {lines[s + len(c) - 1] for s, c in L.line_chunks(lines)}
    shifted = {([b"new one", b"another", *lines])[s + len(c) - 1]
               for s, c in L.line_chunks([b"new one", b"another", *lines])}
    assert len(ends - shifted) <= 1


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = L.stage_line_dedup(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(1, None), (2, ""), (3, " \n\t "), (None, None), (6, "same row")} <= got
    assert L.remove_passages(no_docs).count() == 0


def runs(lines, min_words=L.MIN_WORDS):
    """(start, end) of the shortest runs of more than `min_words` words from each
    line on, without those that are long enough without their first line."""
    n = [len(x.split()) for x in lines]
    for i in range(len(lines)):
        end = next((e for e in range(i, len(lines) + 1) if sum(n[i:e]) > min_words), None)
        if end and sum(n[i + 1:end]) <= min_words:
            yield i, end


def must_go(rows):
    """Lines (by doc_id) of every run that stands earlier, found without chunks or hashes."""
    places = defaultdict(list)
    for i, text in sorted(rows):
        lines = text.split("\n")
        for a, b in runs(lines):
            places[tuple(lines[a:b])].append((i, a, b))
    gone = defaultdict(set)
    for (i1, a1, b1), *later in places.values():
        for i, a, b in later:
            if i != i1 or a >= b1:
                gone[i].update(range(a, b))
    return gone


def check_all_copies_go(spark, rows):
    """All lines of repeated runs go; besides them only lines next to one go, and
    each line's first copy stays."""
    out = L.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: r for r in out.collect()}
    gone = must_go(rows)
    assert gone
    for i, text in rows:
        lines = text.split("\n")
        left = got[i]["text"].split("\n") if got[i]["_ld_removed"] < len(lines) else []
        kept = [x for k, x in enumerate(lines) if k not in gone[i]]
        rest = iter(kept)
        assert all(x in rest for x in left), i  # nothing stays that must go
        if not gone[i]:
            assert left == lines
    assert {x for _, t in rows for x in t.split("\n") if x} <= {x for r in got.values() for x in r["text"].split("\n")}
    return got


def test_passages_of_short_lines_are_found_without_a_common_chunk(spark):
    rng = random.Random(11)

    def line(n):
        return " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(n))
    rows = []
    for shape in [(11, 5), (26, 2), (7, 8), (6, 10)] * 25:
        passage = [line(shape[1]) for _ in range(shape[0])]
        for _ in range(2):
            lines = [line(8) for _ in range(4)] + passage + [line(8) for _ in range(4)]
            rows.append((len(rows), "\n".join(lines)))
    got = check_all_copies_go(spark, rows)
    assert all(got[i]["_ld_removed"] == (0 if i % 2 == 0 else len(rows[i][1].split("\n")) - 8) for i in got)


def test_copies_in_surroundings_unlike_the_first(spark):
    rng = random.Random(12)

    def line(n):
        return " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(n))
    hot = [line(20) for _ in range(4)]  # a chunk each or two: 20 of 16 words always end one
    passage = "\n".join(hot)
    rows = [(0, "\n".join(x for h in hot for x in (h, line(6)))), (1, "\n".join(reversed(hot)))]
    rows += [(i, "\n".join([line(9), passage, line(9)])) for i in range(2, 12)]
    got = check_all_copies_go(spark, rows)
    assert [got[i]["_ld_removed"] for i in range(12)] == [0, 0, 0] + [4] * 9
