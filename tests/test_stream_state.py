"""Streams with a stored state: summaries and admission, in order and out of order."""

import datetime as dt
import random

from feedlake.operators import monitoring as mon
from feedlake.operators.sources import update_source_stats
from feedlake.streaming import admission, summaries
from feedlake.streaming.remerge import SOURCES

T0 = dt.datetime(2024, 1, 1)
LOG = "source_id STRING, event_id BIGINT, ts TIMESTAMP, ok BOOLEAN, error STRING"
RUNS = "name STRING, event_id BIGINT, interval_s DOUBLE, start TIMESTAMP, end TIMESTAMP, ok BOOLEAN, error STRING"
REQUESTS = "event_id BIGINT, key STRING, ts TIMESTAMP"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def fetches(rng, n):
    return [(f"s{rng.randrange(4)}", i, at(100 * i), rng.random() < 0.7, f"e{i}") for i in range(n)]


def sources(spark):
    rows = [(f"s{i}", "n", "u", i != 2, None, 1, 1.0, 0.5, 0, 0, 0, None) for i in range(5)]
    return spark.createDataFrame(rows, SOURCES)


def test_fetches_in_order_give_the_batch_result_and_reruns_change_nothing(spark, tmp_path):
    rows, summary = fetches(random.Random(1), 90), summaries.fetch_summary()
    for n in (0, 1, 1, 2):
        summary.add(spark.createDataFrame(rows[n * 30:n * 30 + 30], LOG), str(tmp_path), n + 1)
    got = summaries.source_stats_of(summary.state(str(tmp_path)).read(spark), sources(spark))
    assert {r.late_rows for r in got.collect()} == {0}
    want = update_source_stats(sources(spark), spark.createDataFrame(rows, LOG), "event_id")
    assert sorted(map(tuple, got.drop("late_rows").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    summary = summaries.run_summary()
    run = lambda name, i, end, ok: (name, i, 60.0, at(end - 5), at(end), ok, None if ok else "E: x")
    first = [run("a", 1, 10_000, True), run("b", 2, 9_000, False)]
    # Within an hour of the newest: counted, but not the last run of its job. Before: late.
    second = [run("a", 3, 6_500, False), run("a", 4, 6_000, False), run("c", 5, 10, True), run("b", 6, 12_000, True)]
    for n, rows in enumerate((first, second)):
        summary.add(spark.createDataFrame(rows, RUNS), str(tmp_path), n + 1, late_s=3600)
    got = {r["name"]: r for r in summaries.job_runs_of(summary.state(str(tmp_path)).read(spark)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].run_count, got["a"].late_rows, got["a"].last_status, got["a"].last_run_end) == (2, 1, "success", at(10_000))
    assert (got["b"].run_count, got["b"].late_rows, got["b"].last_status) == (2, 0, "success")
    state = {r["name"]: r.late_rows for r in summary.state(str(tmp_path)).read(spark).collect()}
    assert state == {"a": 1, "b": 0, "c": 1}
    kept = spark.createDataFrame([r for r in first + second if r[1] not in (4, 5)], RUNS)
    want = {r["name"]: tuple(r) for r in mon.job_run_summary(kept, "event_id").collect()}
    plain = summaries.job_runs_of(summary.state(str(tmp_path)).read(spark)).drop("late_rows")
    assert {r["name"]: tuple(r) for r in plain.collect()} == want


def sequential(rows, limit, window):
    recent, answers = {}, {}
    for event, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [t for t in recent.get(key, []) if (ts - t).total_seconds() < window]
        answers[event] = len(live) < limit
        recent[key] = live + [ts] if answers[event] else live
    return answers


def test_admission_in_order_equals_one_run(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab"), at(7 * i)) for i in range(240)]
    for n in (0, 1, 2, 2):
        admission.admit_batch(spark.createDataFrame(rows[n * 80:n * 80 + 80], REQUESTS), str(tmp_path), n + 1, limit=3, window_s=60)
    got = admission.read_answers(spark, str(tmp_path)).collect()
    assert {r.event_id: r.admitted for r in got} == sequential(rows, 3, 60)
    assert len(got) == 240 and not any(r.late for r in got)


def test_late_requests_are_answered_and_flagged(spark, tmp_path):
    path = str(tmp_path)
    admission.admit_batch(spark.createDataFrame([(1, "a", at(100)), (2, "a", at(130)), (3, "a", None)], REQUESTS), path, 1, limit=2)
    # 4 is late; 5 comes after younger ones of its key and counts as made at 130; 6 finds room.
    more = [(4, "a", at(69)), (5, "a", at(80)), (6, "a", at(165)), (7, "b", at(75))]
    admission.admit_batch(spark.createDataFrame(more, REQUESTS), path, 2, limit=2)
    got = {r.event_id: (r.admitted, r.late) for r in admission.read_answers(spark, path).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, True), 5: (False, False), 6: (True, False), 7: (True, False)}
