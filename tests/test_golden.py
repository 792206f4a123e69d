"""Conversion columns recomputed from published user counts.

Fixed values: the platform funnel published with the original analysis
(users per step for android, ios, web) and its conversion columns."""

import pytest

from ridelens.operators.funnel import with_conversion

PUBLISHED_USERS = {
    "android": [6935, 5148, 3619, 1830],
    "ios": [14290, 10728, 7550, 3792],
    "web": [2383, 1747, 1237, 611],
}
PUBLISHED_PCT_PREVIOUS = {
    "android": [None, 0.7423215573179525, 0.7029914529914529, 0.5056645482177398],
    "ios": [None, 0.7507347795661301, 0.7037658463832961, 0.5022516556291391],
    "web": [None, 0.7331095258078053, 0.7080709788208357, 0.4939369442198868],
}
PUBLISHED_PCT_TOP = {
    "android": [1.0, 0.7423215573179525, 0.5218457101658255, 0.2638788752703677],
    "ios": [1.0, 0.7507347795661301, 0.5283414975507348, 0.26536039188243526],
    "web": [1.0, 0.7331095258078053, 0.5190935795216114, 0.2563994964330676],
}


def test_conversion_matches_published(spark):
    rows = [(step + 1, platform, users[step])
            for platform, users in PUBLISHED_USERS.items() for step in range(4)]
    df = spark.createDataFrame(rows, "funnel_step int, platform string, users bigint")
    got = {(r.platform, r.funnel_step): r for r in with_conversion(df, ["platform"]).collect()}
    for platform, users in PUBLISHED_USERS.items():
        for i in range(4):
            r = got[(platform, i + 1)]
            assert r.previous_users == (users[i - 1] if i else None)
            expected_prev = PUBLISHED_PCT_PREVIOUS[platform][i]
            if expected_prev is None:
                assert r.pct_previous_value is None
            else:
                assert r.pct_previous_value == pytest.approx(expected_prev, rel=1e-12)
            assert r.pct_from_top == pytest.approx(PUBLISHED_PCT_TOP[platform][i], rel=1e-12)


def test_zero_users_give_null_not_error(spark):
    df = spark.createDataFrame([(1, "x", None), (3, "x", 0), (4, "x", 0)],
                               "funnel_step int, platform string, users bigint")
    rows = sorted(with_conversion(df, ["platform"]).collect(), key=lambda r: r.funnel_step)
    assert [r.pct_previous_value for r in rows] == [None, None, None]
    assert [r.pct_from_top for r in rows] == [None, None, None]
