import random

import numpy as np

from ridelens.llm import neardup as N


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(N.LOWER).split()
        n = min(5, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)]


def compare(spark, rows, **more):
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **more).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10 ** 6)}" for w in words]


def test_groups_chains_and_copies(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150]))]
        text = base
        for _ in range(6):  # each a little away from the one before: chains
            rows.append((len(rows), " ".join(text)))
            text = edited(rng, text, 0.02)
        rows += [(len(rows) + k, " ".join(base)) for k in range(3)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "One two"), (len(rows) + 3, "one TWO")]
    compare(spark, rows)


def test_large_group_is_exact(spark):
    """Buckets above the pair bound: star links, then the prefix filter."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(140)]
    rows = []
    for k in range(160):
        share = rng.choice([0.0, 0.01, 0.02, 0.04, 0.06])
        text = edited(rng, base, share)
        rows.append((2 * k, " ".join(text)))
        rows.append((2 * k + 1, " ".join(edited(rng, text, 0.01))))
    compare(spark, rows, pair_bucket=4)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = N.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[6]] == [6, 6]
    assert {r["component_id"] for r in by[None]} == {None} and by[1][0]["kept"] and by[1][0]["n_shingles"] == 0
    assert N.near_duplicates(no_docs).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    m = N.MinHash(N.BANDS, N.ROWS, N.SKETCH_BITS)
    limit = N.most_flips(0.75, N.BANDS * N.ROWS, N.SKETCH_BITS)
    flips = {}
    for share in (0.2, 0.75, 0.95):
        a = rng.integers(0, 1 << 63, 2000, np.uint64)
        k = round(2000 * 2 * share / (1 + share)) if share < 1 else 2000
        b = np.concatenate([a[:k], rng.integers(0, 1 << 63, 2000 - k, np.uint64)])
        s = m.odd_sketch(np.stack([m.samples(a), m.samples(b)])).view(np.uint64)
        flips[share] = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert flips[0.95] < flips[0.75] < flips[0.2]
    assert flips[0.75] <= limit < flips[0.2]


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in N.components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_same_as_sql(same_as_sql):
    same_as_sql("op1_near_duplicates")


def test_stage_with_repeated_and_null_ids(spark):
    rng = random.Random(6)

    def text():
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    near = d + " one more"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, near), (None, c), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = [(r["doc_id"], r["text"]) for r in N.stage_near_duplicates(spark, docs, "").collect()]
    nulls = [t for i, t in left if i is None]
    assert len(nulls) == 1 and nulls[0] in (d, near)
    assert sorted((x for x in left if x[0] is not None), key=repr) == sorted(
        [(1, a), (2, b), (3, c), (4, ""), (4, None)], key=repr)
