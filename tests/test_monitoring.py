"""Rollups and throttling."""

import datetime as dt
import random

import pytest

from feedlake.operators import monitoring as mon
from feedlake.operators.throttle import throttle

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("a", 1.0, at(0), 1), ("a", 2.5, at(5), 2), ("a", 0.12345, at(5), 3), ("b", 7.0, at(1), 4)]
    return spark.createDataFrame(rows, "name STRING, value DOUBLE, ts TIMESTAMP, seq INT")


def test_counters_gauges_timings(samples):
    assert sorted(map(tuple, mon.metric_counters(samples).collect())) == [("a", 3.62345), ("b", 7.0)]
    assert sorted(map(tuple, mon.metric_gauges(samples, "seq").collect())) == [("a", 0.12345), ("b", 7.0)]
    assert sorted(map(tuple, mon.timing_summary(samples, "seq").collect())) == [
        ("a", 0.1235 if round(0.12345, 4) == 0.1235 else 0.1234, 3, 3.6235 if round(3.62345, 4) == 3.6235 else 3.6234, round(3.62345 / 3, 4), 2.5),
        ("b", 7.0, 1, 7.0, 7.0, 7.0),
    ]


def test_errors_and_dashboard(spark, samples):
    errors = spark.createDataFrame(
        [("fetch", "E1", "first", at(0)), ("fetch", "E2", "last", at(9)), ("store", "E3", "only", at(4)), (None, "E4", "lost", at(5))],
        "component STRING, type STRING, message STRING, ts TIMESTAMP",
    )
    got = {(r.component, r.is_total): (r.errors_total, r.last_error.message) for r in mon.error_summary(errors).collect()}
    assert got == {("fetch", False): (2, "last"), ("store", False): (1, "only"), ("unknown", False): (1, "lost"), (None, True): (4, "last")}
    board = mon.dashboard_summary(samples, errors, None).first()
    assert board.status == "ok"
    assert board.metrics["total_errors"] == 4 and board.metrics["errors_fetch_total"] == 2 and board.metrics["b"] == 7.0
    assert board.metrics["a_executions_total"] == 3
    assert board.error_details["store"].type == "E3"


def test_event_log(spark):
    df = spark.createDataFrame(
        [(at(1), "x", "warning", "m", "text", None), (at(2), "y", "info", "m", "text", {"k": "v"})],
        "ts TIMESTAMP, event_type STRING, severity STRING, module STRING, message STRING, details MAP<STRING, STRING>",
    )
    a, b = mon.event_log(df).orderBy("timestamp").collect()
    assert (a.timestamp, a.severity, a.details) == ("2024-01-01T00:00:01Z", "WARNING", {})
    assert b.details == {"k": "v"}


def test_job_runs(spark):
    runs = spark.createDataFrame(
        [
            ("j", 300.0, at(0), at(2), False, "ValueError: x"), ("j", 300.0, at(10), at(14), True, None),
            ("k", 60.0, at(0), at(1), True, None), ("k", 60.0, at(5), at(6), False, "KeyError: y"),
        ],
        "name STRING, interval_s DOUBLE, start TIMESTAMP, end TIMESTAMP, ok BOOLEAN, error STRING",
    )
    j, k = mon.job_run_summary(runs).orderBy("name").collect()
    assert (j.run_count, j.success_count, j.failure_count, j.last_status, j.last_error) == (2, 1, 1, "success", None)
    assert (j.last_duration, j.next_run) == (4.0, at(314))
    assert (k.last_status, k.last_error, k.next_run) == ("failed", "KeyError: y", at(66))


def requests(spark, rows):
    return spark.createDataFrame(rows, "event_id INT, key STRING, ts TIMESTAMP")


def sequential(rows, limit, window):
    recent, answers = {}, {}
    for event, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = [t for t in recent.get(key, []) if (ts - t).total_seconds() < window]
        answers[event] = len(live) < limit
        recent[key] = live + [ts] if answers[event] else live
    return answers


def test_throttle_window_edge(spark):
    rows = [(i, "c", at(s)) for i, s in enumerate([0, 10, 20, 60, 61])]
    got = {r.event_id: r.admitted for r in throttle(requests(spark, rows), limit=2).collect()}
    assert [got[i] for i in range(5)] == [True, True, False, True, False]


@pytest.mark.parametrize("limit, window", [(1, 60), (3, 60), (5, 300)])
def test_throttle_hot_key_over_many_partitions(spark, limit, window):
    """A key with most of the rows and never a quiet gap; answers depend on all before."""
    rng = random.Random(limit)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0, 1, 5, 19])
        rows.append((i, "hot" if rng.random() < 0.8 else f"k{rng.randrange(40)}", at(t)))
    got = throttle(requests(spark, rows), limit=limit, window_s=window, partitions=9)
    assert {r.event_id: r.admitted for r in got.collect()} == sequential(rows, limit, window)


def test_requests_without_a_time_are_not_admitted(spark):
    rows = [(1, "c", at(0)), (2, "c", None), (3, "c", at(1)), (4, "d", None)]
    got = throttle(requests(spark, rows), limit=2, window_s=60)
    assert {r.event_id: r.admitted for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_rolling_count(spark):
    rng = random.Random(3)
    rows = [(i, f"k{rng.randrange(2)}", at(rng.randrange(900))) for i in range(200)]
    got = {r.event_id: r.n_prev for r in mon.rolling_request_count(requests(spark, rows), window_s=60).collect()}
    for event, key, ts in rows:
        inside = [r for r in rows if r[1] == key and 0 <= (ts - r[2]).total_seconds() <= 60]
        assert got[event] == len(inside) - 1
