"""Sessions and sliding windows of a stream that arrives out of order, with rows that come too late."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from stampline.streaming.windows import Arrivals, late_events, silence_sessions, sliding_counts

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
NOON = datetime(2024, 5, 1, 12)


def at(minutes):
    return NOON + timedelta(minutes=minutes)


#: What arrives in which batch: (event, user, minutes after noon or None). The watermark is 60 minutes behind the newest event of the batches before.
BATCHES = [
    [(1, 1, 0), (2, 1, 5), (3, 1, 20), (4, 2, 100), (5, None, 50), (6, 3, None)],  # then the watermark is at 40
    [(7, 1, 31), (8, 1, 30), (9, 1, 12), (10, 2, 41), (11, 1, 29), (12, 2, 200)],  # 12, 29 and 30 would end by 40; then at 140
    [(13, 2, 131), (14, 2, 129), (15, 2, 400)],  # 129 would end at 139; then at 340
]


@pytest.fixture
def arrive(spark):
    def run(build):
        arrivals = Arrivals(spark, SCHEMA)
        result = build(arrivals.stream)
        seen = []
        for batch in BATCHES:
            rows = [(e, None if m is None else at(m), u, "x", float(e)) for e, u, m in batch]
            arrivals.add(spark.createDataFrame(rows, SCHEMA).repartition(3), result)
            seen.append(arrivals.given(result).collect())
        return seen

    return run


def test_sessions(arrive):
    seen = arrive(lambda s: silence_sessions(s, "user_id", "10 minutes", "60 minutes"))
    got = [{(r["user_id"], (r["start"] - NOON).seconds // 60, (r["end"] - NOON).seconds // 60, r["n_events"], r["value"]) for r in rows} for rows in seen]
    first = {(1, 0, 15, 2, 3.0), (1, 20, 30, 1, 3.0)}
    assert got[0] == first
    # 31 comes after the session before it has gone out; 12, 29 and 30 are too late
    assert got[1] == first | {(None, 50, 60, 1, 5.0), (1, 31, 41, 1, 7.0), (2, 41, 51, 1, 10.0), (2, 100, 110, 1, 4.0)}
    assert got[2] == got[1] | {(2, 131, 141, 1, 13.0), (2, 200, 210, 1, 12.0)}


def test_late_rows_are_those_that_sessions_drop(arrive):
    got = [sorted(r["event_id"] for r in rows) for rows in arrive(lambda s: late_events(s, "user_id", 10 * 60_000, "60 minutes"))]
    assert got == [[], [8, 9, 11], [8, 9, 11, 14]]


def test_sliding_windows(arrive):
    seen = arrive(lambda s: sliding_counts(s, "user_id", "20 minutes", "10 minutes", "60 minutes"))
    got = {(r["user_id"], int((r["start"] - NOON).total_seconds() // 60)): r["n_events"] for r in seen[-1]}
    # a row counts in each of its windows that has not gone out yet: 30 and 31 still in that from 30, 29 in none, 131 no longer in that from 120
    assert got == {(1, -10): 2, (1, 0): 2, (1, 10): 1, (1, 20): 1, (1, 30): 2, (None, 40): 1, (None, 50): 1, (2, 30): 1, (2, 40): 1, (2, 90): 1, (2, 100): 1, (2, 130): 1, (2, 190): 1, (2, 200): 1}
    assert all((r["end"] - r["start"]) == timedelta(minutes=20) for r in seen[-1])
