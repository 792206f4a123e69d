"""Filter predicates against a plain-Python model of the dashboard's pandas
semantics (a missing value fails every comparison), on random labels and
bounds drawn from the age/platform domains plus the 'None' sentinel."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ridelens.operators.filters import (NO_AGE_BOUND, age_between_null_tolerant,
                                        age_between_unless_unset, text_between)
from ridelens.sources.schemas import AGE_RANGES, PLATFORMS

LABELS = st.one_of(st.none(), st.sampled_from(AGE_RANGES + PLATFORMS + ["10-17", "65-74"]))
BOUNDS = st.sampled_from(AGE_RANGES + PLATFORMS + [NO_AGE_BOUND])


def lt_eq(a, b):
    return a is not None and a <= b


def gt_eq(a, b):
    return a is not None and a >= b


def model_between(x, lo, hi):
    return gt_eq(x, lo) and lt_eq(x, hi)


def model_unless_unset(x, lo, hi):
    return True if NO_AGE_BOUND in (lo, hi) else model_between(x, lo, hi)


def model_null_tolerant(x, lo, hi):
    return (gt_eq(x, lo) or x is None) and (lt_eq(x, hi) or x == "Unknown")


def kept(spark, values, cond):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, age_range string")
    return sorted(r.i for r in df.where(cond).collect())


@settings(max_examples=25, deadline=None)
@given(values=st.lists(LABELS, min_size=1, max_size=12), lo=BOUNDS, hi=BOUNDS)
def test_filters_follow_the_dashboard_semantics(spark, values, lo, hi):
    for predicate, model in ((text_between, model_between),
                             (age_between_unless_unset, model_unless_unset),
                             (age_between_null_tolerant, model_null_tolerant)):
        expected = [i for i, v in enumerate(values) if model(v, lo, hi)]
        assert kept(spark, values, predicate("age_range", lo, hi)) == expected, predicate.__name__
