"""Anchored limits in batch against the plain rule."""

import random
from datetime import datetime, timedelta

import pytest

from tanik.operators.limits import limit_windows
from tanik.streaming.jobs import anchored

BEGIN = datetime(2026, 9, 1)


def plain(rows, limit, seconds):
    out, keys = [], {}
    for key, rid, at in rows:
        if key is None or at is None:
            out.append((key, rid, None))
        else:
            keys.setdefault(key, []).append((at, rid))
    for key, some in keys.items():
        some.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        allowed, _, _ = anchored([(at - BEGIN) // timedelta(microseconds=1) for at, _ in some], limit, seconds)
        out += [(key, rid, a) for (_, rid), a in zip(some, allowed)]
    return out


def check(spark, rows, limit, seconds):
    df = spark.createDataFrame(rows, "key string, request_id long, at timestamp")
    got = [tuple(r) for r in limit_windows(df, limit, seconds).collect()]
    shown = lambda some: sorted(map(str, some))
    assert shown(got) == shown(plain(rows, limit, seconds))


@pytest.mark.parametrize("seconds, limit", [(60, 3), (3600, 1), (1, 2)])
def test_like_the_plain_rule(spark, seconds, limit):
    draw = random.Random(seconds)
    at = lambda: BEGIN + timedelta(milliseconds=draw.randrange(400_000))
    rows = [(draw.choice("aaab"), k, at()) for k in range(600)]  # one key holds most rows
    rows += [("c", k, BEGIN + timedelta(seconds=k * seconds)) for k in range(40)]  # each request ends the window before
    rows += [("d", k, BEGIN) for k in range(9)] + [("e", 5, BEGIN)] * 4 + [("f", None, BEGIN)] * 2  # ties, repeated rows, no id
    rows += [(None, 1, BEGIN), ("a", 2, None), ("g", 1, BEGIN + timedelta(days=900)), ("g", 2, BEGIN - timedelta(days=30000))]
    check(spark, rows, limit, seconds)


def test_no_requests_and_no_limit(spark):
    check(spark, [], 3, 60)
    check(spark, [("a", 1, BEGIN), ("a", 2, BEGIN)], 0, 60)


def test_only_first_rows_of_a_window_are_dealt(spark):
    df = spark.range(100).selectExpr("'a' AS key", "id AS request_id", "timestamp_seconds(id) AS at")
    plan = limit_windows(df, 3, 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
