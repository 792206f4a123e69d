from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.llm import filter_audit as A


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_least_squares_solution_is_the_mean_over_orders(n):
    m = A.integer_weights(n)
    value = [(s * 7919 + s * s * 31) % 1009 if s else 0 for s in range(1 << n)]
    for i in range(n):
        marginal = 0
        for order in permutations(range(n)):
            before = sum(1 << k for k in order[:order.index(i)])
            marginal += value[before | 1 << i] - value[before]
        assert sum(w * v for w, v in zip(m[i], value)) == marginal
    assert sum(sum(w * v for w, v in zip(row, value)) for row in m) == factorial(n) * value[-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=3, max_size=3))
def test_elimination_in_rationals(matrix):
    a, b, c = matrix
    det = (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0])
           + a[2] * (b[0] * c[1] - b[1] * c[0]))
    if det:
        x = A.solve([[Fraction(v) for v in r] for r in matrix], [[Fraction(k)] for k in (1, 2, 3)])
        assert [sum(v * y[0] for v, y in zip(r, x)) for r in matrix] == [1, 2, 3]


def words(text):
    return text.encode("utf-8").split()  # the same white space


def brute_force(docs, labels):
    """Rows (doc_id, text, source) and (doc_id, quality, toxic), order by order."""
    fails = []
    for i, text, source in docs:
        t, w = text or "", words(text or "")
        copies = [j for j, u, _ in docs if (u or "") == t and j is not None and i is not None and j < i]
        fails.append((source or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": bool(copies)},
            any(j == i and q == 1 for j, q, _ in labels if j is not None),
            any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = []
    for part in {f[0] for f in fails}:
        mine, shapley, rows = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                shapley[name] += len(gone)
                rows.append((part, order, step, len(left), len(gone), sum(f[1][name] for f in mine) - len(gone),
                             sum(f[1][name] and sum(f[1].values()) == 1 for f in mine),
                             sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [(1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (3, LONG, "a"), (4, LONG + " #", "a"), (5, LONG.upper(), None),
        (6, "w " * 300, "b"), (7, None, "a"), (8, "", ""), (None, LONG, "a"), (None, None, None), (9, "A$", "x"),
        (10, LONG.upper() + " |", "b"), (2, "other", "b"), (11, "é ß " * 300, "x"), (12, LONG, "b"),
        (13, " ".join(f"v{i % 120}" for i in range(240)), "b"), (14, "x" * 70_000, "a")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (5, None, 1), (6, 1, 1), (None, 1, 1), (8, 1, 0), (10, 0, 1),
          (99, 1, 1), (12, 1, 1)]


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "m", 2) for r in docs],
                              "doc_id long, text string, source string, part int, mask string, `a.b` int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = A.audit(A.failure_cells(d.repartition(3), lab), "ABCDE").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley").collect()
    return sorted(map(tuple, rows))


def test_equals_filtering_order_by_order(spark):
    assert audited(spark, DOCS, LABELS) == brute_force(DOCS, LABELS)


def test_without_labels_and_without_documents(spark):
    assert audited(spark, DOCS, []) == brute_force(DOCS, [])
    assert audited(spark, [], LABELS) == []


def test_query_equals_sql(same_as_sql):
    same_as_sql("op12_filter_audit")
