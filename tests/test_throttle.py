"""Admission with limit 1 by composed steps."""

import datetime as dt
import random

import numpy as np

from feedlake.operators import throttle as TH

T0 = dt.datetime(2024, 1, 1)


def walked(times, x, window):
    """Earliest next admission after ``times``, one request at a time."""
    for t in times:
        if t >= x:
            x = t + window
    return x


def some_times(rng, n, start):
    return np.array(sorted(start + rng.randrange(0, 40) for _ in range(n)), np.int64)


def test_steps_of_a_range():
    rng = random.Random(3)
    for _ in range(400):
        window = rng.randrange(1, 30)
        times = some_times(rng, rng.randrange(1, 25), 100)
        xs, ys = TH.transfer(times, window)
        asked = np.array([TH.FREE, *range(50, int(times[0]) + window + 1)])
        assert TH.apply_steps(xs, ys, asked).tolist() == [walked(times, x, window) for x in asked.tolist()]


def test_steps_compose():
    rng = random.Random(4)
    for _ in range(400):
        window = rng.randrange(1, 30)
        whole = some_times(rng, rng.randrange(3, 40), 100)
        cut = sorted(rng.sample(range(1, len(whole)), 2))
        parts = [p for p in np.split(whole, cut) if len(p)]
        steps = TH.transfer(parts[0], window)
        for p in parts[1:]:
            steps = TH.compose(steps, TH.transfer(p, window))
        asked = np.array([TH.FREE, *range(50, int(whole[0]) + window + 1)])
        assert TH.apply_steps(*steps, asked).tolist() == [walked(whole, x, window) for x in asked.tolist()]


def requests(spark, rng, n, busy):
    """One key that is full all the time and some quiet ones."""
    rows = [(i, "busy" if rng.random() < busy else f"q{rng.randrange(5)}", T0 + dt.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id int, key string, ts timestamp"), rows


def answers(rows, window):
    last, out = {}, {}
    for i, key, ts in rows:
        out[i] = key not in last or (ts - last[key]).total_seconds() >= window
        if out[i]:
            last[key] = ts
    return out


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    result = work()
    spark.sparkContext.setJobGroup("rest", "rest")
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_a_full_key_grow_with_the_logarithm(spark):
    df, rows = requests(spark, random.Random(5), 1500, 0.95)
    want, jobs = answers(rows, 7), []
    for partitions in (4, 8, 16, 32):
        got, n = jobs_of(spark, f"full-{partitions}", lambda: TH.throttle(df, limit=1, window_s=7, partitions=partitions).collect())
        assert {r.event_id: r.admitted for r in got} == want
        jobs.append(n)
    steps = [b - a for a, b in zip(jobs, jobs[1:])]
    assert max(steps) <= 4


def test_keys_that_end_and_begin_inside_partitions(spark):
    for seed, partitions in ((1, 3), (2, 11), (3, 40)):
        df, rows = requests(spark, random.Random(seed), 160, 0.6)
        got = TH.throttle(df, limit=1, window_s=5, partitions=partitions).collect()
        assert {r.event_id: r.admitted for r in got} == answers(rows, 5)
