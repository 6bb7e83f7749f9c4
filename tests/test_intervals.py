"""Interval joins against every pair, and bins with very many rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from stampline.operators import intervals

LEFT, RIGHT = "k long, start long, end long, a long", "k long, start long, end long, a long, b string"


def shares(s, e, s2, e2):
    return s2 < e2 and s2 <= s < e2 or s < e and s <= s2 < e or s == e == s2 == e2


def every(left, right):
    ok = lambda r: None not in r[:3] and r[2] >= r[1]
    return Counter((x[0], *x[1:4], *y[1:5]) for x in left for y in right if ok(x) and ok(y) and x[0] == y[0] and shares(*x[1:3], *y[1:3]))


def rows(dice, n, lengths):
    out = []
    for i in range(n):
        start = dice.randrange(-2000, 2000)
        out.append((dice.choice([1, 1, 1, 2, None]), None if dice.random() < 0.02 else start, start + dice.choice(lengths), i))
    return out


@pytest.mark.parametrize(("lengths", "most"), [([0], 3), ([0, 1, 10, 100, 3000], 10_000), ([-5, 0, 64, 16, 4, 1, 256], 3)])
def test_all_pairs(spark, lengths, most):
    dice = random.Random(len(lengths) + most)
    left = rows(dice, 150, lengths)
    right = [(*r, "x") for r in rows(dice, 120, [0, 1, 5, 40, 700])]
    left += left[:5]
    for base in (None, 4.0):
        got = intervals.interval_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", base, most)
        assert got.columns == ["k", "start", "end", "a", "start_right", "end_right", "a_right", "b"]
        assert Counter(map(tuple, got.collect())) == every(left, right)


def test_no_nested_loop_and_empty_sides(spark):
    left, right = spark.createDataFrame([(1, 0, 5, 1)], LEFT), spark.createDataFrame([(1, 2, 9, 1, "x")], RIGHT)
    for hint in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
        plan = intervals.interval_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert intervals.interval_join(left.limit(0), right, "k").count() == intervals.interval_join(left, right.limit(0), "k").count() == 0


def test_a_hot_bin_is_dealt_out(spark):
    """A third of all rows in one moment of one key: no part takes more than its share, and no row has more copies than levels and parts."""
    hot = spark.range(30_000).selectExpr("7L as _key", "100L as _start", "100L as _end", "0 as _at", "100L as _bin", "named_struct('i', id) as _row")
    few = spark.range(3).selectExpr("7L as _key", "90L as _start", "101L as _end", "0 as _at", "100L as _bin", "named_struct('j', id) as _row")
    left, right = intervals._split(hot, few, 1000)
    sizes = [r["count"] for r in left.groupBy("_part").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1300 and right.count() == 90
    whole = intervals.interval_join(hot.selectExpr("_key as k", "_start as start", "_end as end"), few.selectExpr("_key as k", "_start as start", "_end as end"), "k", most=1000)
    assert whole.count() == 90_000


def test_a_long_window_is_in_few_bins(spark):
    wide = spark.createDataFrame([(1, 0, 10**9, 1)], LEFT).selectExpr("k as _key", "start as _start", "end as _end", "struct(a) as _row")
    assert intervals._bins(wide, 10.0, [0, 1, 2]).count() <= 2
    word = spark.createDataFrame([(1, 5, 9, 1)], LEFT).selectExpr("k as _key", "start as _start", "end as _end", "struct(a) as _row")
    assert intervals._bins(word, 10.0, [0, 3, 14]).count() == 3
