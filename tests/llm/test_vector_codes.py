import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.llm import vector_codes as V


def nearest(x, entries):
    squares = [(sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries)]
    square, k = min(squares)
    return k, square


POINT = st.lists(st.integers(-4, 4), min_size=2, max_size=2)


@settings(max_examples=200, deadline=None)
@given(st.lists(POINT, min_size=1, max_size=9), st.lists(POINT, min_size=1, max_size=30), st.lists(POINT, max_size=9))
def test_balls_find_the_nearest_entry(entries, points, shifts):
    """From any assignment with an unknown radius, then after the entries moved
    with the radius bound: ties, equal entries and quiet balls included."""
    e, x = np.array(entries, np.int64), np.array(points, np.int64)
    balls = V.make_balls(e)
    for start in (np.zeros(len(x), np.int64), np.arange(len(x)) % len(e)):
        got = V.assign(x, start, balls)
        assert list(zip(*map(np.ndarray.tolist, got))) == [nearest(p, entries) for p in points]
    code, square = got
    far = [max([int(s) for s, c in zip(square, code) if c == k], default=0) for k in range(len(e))]
    moved = e.copy()
    for k, shift in enumerate(shifts[:len(e)]):
        moved[k] += np.array(shift) // 3
    way = ((moved - e) ** 2).sum(1)
    radius = [V._ceil_root(f) + V._ceil_root(int(w)) for f, w in zip(far, way)]
    again = V.assign(x, code, V.make_balls(moved, way > 0, radius))
    assert list(zip(*map(np.ndarray.tolist, again))) == [nearest(p, moved.tolist()) for p in points]


def test_cores_and_rings_save_distances():
    rng = np.random.default_rng(1)
    e = rng.integers(-1000, 1000, (64, 2))
    x = e[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 2))
    first, square = V.assign(x, np.zeros(5000, np.int64), V.make_balls(e))
    radius = [V._ceil_root(int(max(square[first == k], default=0))) for k in range(64)]
    balls = V.make_balls(e, np.ones(64, bool), radius)
    assert balls.reach.mean() < 16 and not balls.quiet.any()
    core = 4 * square < balls.gaps[first, 0]
    assert core.mean() > 0.5
    assert V.make_balls(e, np.zeros(64, bool), radius).quiet.all()


def brute_force(rows, parts, size, rounds):
    """rows: (vec_id, vector, label) -> [(vec_id, code, error)], codebooks."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = len(whole[0][1]) // parts
    first = sorted((i, x) for i, x in whole if i is not None)[:size]
    books = [[x[p * d:p * d + d] for _, x in first] for p in range(parts)]

    def codes(x):
        return [nearest(x[p * d:p * d + d], books[p]) for p in range(parts)]
    for _ in range(rounds):
        assigned = [(x, codes(x)) for _, x in whole]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x[p * d:p * d + d] for x, c in assigned if c[p][0] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    return [(i, bytes(k for k, _ in codes(x)).hex(), sum(s for _, s in codes(x))) for i, x in whole], books


SCHEMA = "vec_id long, embedding array<float>, label int, codes string, x int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)


def random_rows(n, width, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]


def test_equals_brute_force(spark):
    rows = random_rows(150, 12)
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[9][1], 0), (500, [0.0] * 12, None), (3, [0.0] * 12, 2)]
    rows += [(1000, None, 1), (1001, [math.nan] + [0.0] * 11, 1), (1002, [math.inf] * 12, 0), (1003, [None] * 12, 0)]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    got, books = V.vector_codes(frame(spark, rows), parts=4, size=20, rounds=3)
    want, want_books = brute_force(rows, 4, 20, 3)
    assert sorted(((r["vec_id"], bytes(r["codes"]).hex(), r["error"]) for r in got.collect()), key=repr) \
        == sorted(want, key=repr)
    assert [b.tolist() for b in books] == want_books
    flat = ",".join(str(v) for b in want_books for e in b for v in e)
    assert V.codebook_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_vectors_that_do_not_fit_are_kept_without_a_code(spark):
    rows = random_rows(10, 8) + [(20, [1.0] * 4, 1), (21, [1e30] * 8, 1), (22, [], 1)]
    got = {r["vec_id"]: r for r in V.vector_codes(frame(spark, rows), parts=4, size=4)[0].collect()}
    assert len(got) == 13
    assert all((got[i]["codes"] is None) == (got[i]["error"] is None) == (i >= 20) for i in got)


def test_empty_table(spark):
    rows, books = V.vector_codes(frame(spark, []))
    assert rows.collect() == [] and books == []
    assert V.vector_codes(frame(spark, [(1, None, 1)]))[0].collect() == []


def test_query_equals_sql(same_as_sql):
    same_as_sql("op11_vector_codes")
