"""Admission under a rolling per-key limit.

A request is admitted when fewer than ``limit`` admitted requests of its key are younger
than the window. Rejected ones do not count, so each answer depends on earlier answers
and a window count cannot give it.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedlake.functions.timestamps import micros
from feedlake.session import keep_partitions, materialize, release, ship

ship(__name__)


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Answers for one key's requests in time order, and its admits that still count after them."""
    both = np.concatenate([np.asarray(recent, dtype=np.int64), times])
    if len(both) <= limit or np.all(both[limit:] - both[:-limit] >= window):
        return np.ones(len(times), dtype=bool), both[-limit:].tolist()
    active = deque(recent)
    answers = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        t = int(times[i])
        while active and t - active[0] >= window:
            active.popleft()
        if len(active) < limit:
            active.append(t)
            answers[i] = True
            i += 1
        else:
            # Full until the oldest admit leaves the window: one step for all in between.
            i = int(np.searchsorted(times, active[0] + window))
    return answers, list(active)


def _runs(keys: np.ndarray):
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], edges])
    return zip(starts, np.concatenate([edges, [len(keys)]]))


def _walk(batches, starts: dict, limit: int, window: int):
    """Per batch: the batch, its answers, and (slot, key, first time, admits) after it."""
    key, recent, started = None, [], False
    for batch in batches:
        if not len(batch):
            continue
        keys, times = batch["key"].to_numpy(), batch["at"].to_numpy()
        answers = np.zeros(len(batch), dtype=bool)
        for lo, hi in _runs(keys):
            if not started or keys[lo] != key:
                recent = [] if started else list(starts.get(int(batch["slot"].iat[0]), []))
                key, started = keys[lo], True
            answers[lo:hi], recent = admit(times[lo:hi], recent, limit, window)
        yield batch, answers, (key, recent)


# --- limit 1: what a range does to the earliest time of the next admission ------------------

#: No restriction, and beyond all times.
FREE, NEVER = -(1 << 62), 1 << 62


def transfer(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How a range of one key's requests changes the earliest admissible time, as steps (xs, ys).

    An earliest time up to xs[i] and above xs[i - 1] becomes ys[i]; one above the last x stays as it is.
    It can lie one window after the first request at most, so only the requests up to there are steps.
    """
    n = len(times)
    following = np.searchsorted(times, times + window)
    after = times + window
    end = n
    while end:
        # All requests of the last window not yet done: the next admission of each is done already.
        begin = int(np.searchsorted(times, times[end - 1] - window, "right"))
        block = np.arange(begin, end)
        inside = following[block] < n
        after[block[inside]] = after[following[block[inside]]]
        end = begin
    use = min(n, int(np.searchsorted(times, times[0] + window)) + 1)
    xs = times[:use].copy()
    if use < n or xs[-1] >= times[0] + window:
        xs[-1] = NEVER
    return _merged(xs, after[:use])


def _merged(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.append(ys[1:] != ys[:-1], True)
    return xs[last], ys[last]


def apply_steps(xs: np.ndarray, ys: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(xs, x)
    return np.where(at < len(xs), ys[np.minimum(at, len(xs) - 1)], x)


def compose(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The steps of ``second`` after ``first``."""
    xs, ys = first
    beyond = second[0] > xs[-1]
    return _merged(
        np.concatenate([xs, second[0][beyond]]), np.concatenate([apply_steps(*second, ys), second[1][beyond]])
    )


STEPS = "at int, xs array<bigint>, ys array<bigint>"


def _chained_starts(rows: DataFrame, edges: dict[int, dict], window: int) -> dict[int, list[int]]:
    """For limit 1, the admit that counts at the start of each partition.

    A partition that holds only the key that the partition before it ends with is open: what it passes
    on depends on what it gets, by a step function. All others pass on what their own requests give. The
    functions of open neighbours are composed two and two, then four and four, so a key over P partitions takes
    log2(P) jobs. The driver sees one number per partition.
    """
    slots = sorted(edges)
    place = {slot: i for i, slot in enumerate(slots)}
    starts, first = {}, {}
    for left, right in zip(slots, slots[1:]):
        a, b = edges[left], edges[right]
        if a["last_key"] != b["first_key"]:
            continue
        if place[left] not in first:
            starts[right] = a["recent"][-1] + window
        if b["first_key"] == b["last_key"]:
            first[place[right]] = first.get(place[left], place[right])
    if first:
        spark = rows.sparkSession
        sent = spark.sparkContext.broadcast((place, first, {place[s]: x for s, x in starts.items()}))

        def read(batches):
            found = [(b["slot"].iat[0], b["at"].to_numpy()) for b in batches if len(b)]
            if found:
                xs, ys = transfer(np.concatenate([t for _, t in found]), window)
                yield pd.DataFrame({"at": [sent.value[0][int(found[0][0])]], "xs": [xs], "ys": [ys]})

        def join(batches):
            for b in batches:
                out = []
                for at, xs, ys, before, pxs, pys in zip(b["at"], b["xs"], b["ys"], b["before"], b["pxs"], b["pys"]):
                    if pxs is not None and before >= sent.value[1][at]:
                        xs, ys = compose((pxs, pys), (xs, ys))
                    out.append((at, xs, ys))
                yield pd.DataFrame(out, columns=["at", "xs", "ys"])

        def end(batches):
            for b in batches:
                yield pd.DataFrame({"at": b["at"], "x": [
                    int(apply_steps(xs, ys, np.array([sent.value[2][sent.value[1][at]]]))[0]) for at, xs, ys in zip(b["at"], b["xs"], b["ys"])
                ]})

        open_ = [slots[i] for i in first]
        steps = materialize(rows.where(F.col("slot").isin(open_)).mapInPandas(read, STEPS))
        reach, longest = 1, max(at - start + 1 for at, start in first.items())
        while reach < longest:
            earlier = steps.select(
                (F.col("at") + reach).alias("at"), F.col("at").alias("before"), F.col("xs").alias("pxs"), F.col("ys").alias("pys"))
            joined = materialize(steps.join(earlier, "at", "left").mapInPandas(join, STEPS))
            release(steps)
            steps, reach = joined, reach * 2
        for r in steps.mapInPandas(end, "at int, x bigint").collect():
            after = r["at"] + 1
            if after < len(slots) and edges[slots[r["at"]]]["last_key"] == edges[slots[after]]["first_key"]:
                starts[slots[after]] = r["x"]
        release(steps)
    return {slot: [x - window] for slot, x in starts.items()}


def throttle(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "event_id",
    limit: int = 60,
    window_s: int = 60,
    partitions: int | None = None,
) -> DataFrame:
    """``tie``, ``key``, ``admitted`` for every request; time order, then ``tie``.

    Requests are range-partitioned by (key, time), so a busy key runs over many
    partitions. Each partition is answered on its own first, as if nothing came before;
    then the admits standing at a partition's end are handed to the next one of the same
    key, and partitions whose start changed are answered again, until no start changes.
    A quiet gap ends the chain; a key that is full all the time takes as many rounds as it
    has partitions. With limit 1 it takes log2 of them (``_chained_starts``). The driver sees
    one row of at most ``limit`` times per partition. A request without a time is not admitted and does
    not count.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    window = window_s * 1_000_000
    every = requests.select(F.col(key).alias("key"), micros(ts).alias("at"), F.col(tie).alias("tie"))
    narrow, timeless = every.where(F.col("at").isNotNull()), every.where(F.col("at").isNull())
    order = ["key", "at", "tie"]
    ranged = narrow.repartitionByRange(partitions, *order) if partitions else narrow.repartitionByRange(*order)
    rows = keep_partitions(ranged.sortWithinPartitions(*order).withColumn("slot", F.spark_partition_id()))
    key_type = narrow.schema["key"].dataType.simpleString()
    tie_type = narrow.schema["tie"].dataType.simpleString()

    def edges_of(starts):
        def run(batches):
            first = None
            for batch, _, (last_key, recent) in _walk(batches, starts, limit, window):
                first = first or (int(batch["slot"].iat[0]), batch["key"].iat[0], int(batch["at"].iat[0]))
            if first:
                yield pd.DataFrame(
                    {"slot": [first[0]], "first_key": [first[1]], "first_at": [first[2]], "last_key": [last_key], "recent": [recent]}
                )
        return run

    schema = f"slot int, first_key {key_type}, first_at bigint, last_key {key_type}, recent array<bigint>"
    starts: dict[int, list[int]] = {}
    edges: dict[int, dict] = {}
    todo = rows
    if limit == 1:
        for r in rows.mapInPandas(edges_of(starts), schema).collect():
            edges[r["slot"]] = r.asDict()
        starts, todo = _chained_starts(rows, edges, window), None
    while todo is not None:
        for r in todo.mapInPandas(edges_of(starts), schema).collect():
            edges[r["slot"]] = r.asDict()
        wanted: dict[int, list[int]] = {}
        slots = sorted(edges)
        for left, right in zip(slots, slots[1:]):
            a, b = edges[left], edges[right]
            if a["last_key"] == b["first_key"]:
                alive = [t for t in a["recent"] if b["first_at"] - t < window]
                if alive:
                    wanted[right] = alive
        stale = [s for s in slots if wanted.get(s) != starts.get(s)]
        starts = wanted
        if not stale:
            break
        todo = rows.where(F.col("slot").isin(stale))

    def answer(batches):
        for batch, answers, _ in _walk(batches, starts, limit, window):
            yield pd.DataFrame({"tie": batch["tie"], "key": batch["key"], "admitted": answers})

    out = rows.mapInPandas(answer, f"tie {tie_type}, key {key_type}, admitted boolean")
    out = out.unionByName(timeless.select("tie", "key", F.lit(False).alias("admitted")))
    return out.withColumnRenamed("tie", tie)
