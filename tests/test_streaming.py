"""Streams run to the end of what is there and compared with the batch results."""

import datetime as dt
import random

import pytest

from feedlake.operators import monitoring as mon
from feedlake.operators.throttle import throttle
from feedlake.sources import feeds, sinks, stores
from feedlake.streaming import ingest, rollups
from feedlake.streaming.throttle import throttle_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id INT, key STRING, ts TIMESTAMP, event_type STRING, value DOUBLE, content STRING"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events landed in three files, in time order."""
    rng = random.Random(1)
    base = tmp_path_factory.mktemp("landed")
    rows = []
    for i in range(300):
        rows.append((i, f"k{rng.randrange(3)}", T0 + dt.timedelta(seconds=i * 20), rng.choice("ab"), float(i % 7), f"c{rng.randrange(50)}"))
    for n in range(3):
        spark.createDataFrame(rows[n * 100:(n + 1) * 100], SCHEMA).coalesce(1).write.parquet(f"{base}/in/p{n}")
    return f"{base}/in"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", f"{tmp_path}/ck"
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def batch(spark, path):
    return spark.read.schema(SCHEMA).parquet(f"{path}/*")


def test_rollup_with_open_windows_equals_the_batch(spark, landed, tmp_path):
    """Three micro-batches; each changes windows of the one before."""
    counts = rollups.event_rollup_stream(stream(spark, landed), by=("event_type",))
    rollups.start_updates(counts, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = rollups.latest_updates(spark, f"{tmp_path}/out", ["window_start", "event_type"])
    want = mon.event_rollup(batch(spark, landed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() > 1


def test_dedup_stream(spark, landed, tmp_path):
    got = run(rollups.dedup_stream(stream(spark, landed)), "first_copies", "append", tmp_path)
    assert got.count() == batch(spark, landed).select("content").distinct().count()


def test_rollup_stream(spark, landed, tmp_path):
    """Windows the watermark has not closed are still open at the end."""
    got = set(map(tuple, run(rollups.event_rollup_stream(stream(spark, landed), "10 minutes"), "windows", "append", tmp_path).collect()))
    whole = set(map(tuple, mon.event_rollup(batch(spark, landed), "10 minutes").collect()))
    assert got and got < whole
    last = max(r[0] for r in got)
    assert got == {r for r in whole if r[0] <= last}


def test_counters_and_gauges_stream(spark, landed, tmp_path):
    samples = stream(spark, landed).withColumnRenamed("event_type", "name")
    whole = batch(spark, landed).withColumnRenamed("event_type", "name")
    got = run(rollups.metric_counters_stream(samples), "counters", "complete", tmp_path / "a")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mon.metric_counters(whole).collect()))
    got = run(rollups.metric_gauges_stream(samples, "event_id"), "gauges", "complete", tmp_path / "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mon.metric_gauges(whole, "event_id").collect()))
    got = run(rollups.timing_summary_stream(samples, "event_id"), "timings", "complete", tmp_path / "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mon.timing_summary(whole, "event_id").collect()))


def test_throttle_stream(spark, landed, tmp_path):
    got = run(throttle_stream(stream(spark, landed), limit=2, window_s=150), "admitted", "append", tmp_path)
    whole = throttle(batch(spark, landed), limit=2, window_s=150)
    assert {r.event_id: r.admitted for r in got.collect()} == {r.event_id: r.admitted for r in whole.collect()}


def test_event_log_stream(spark, tmp_path):
    df = spark.createDataFrame([(T0, "x", "info", "m", "t", None)], "ts TIMESTAMP, event_type STRING, severity STRING, module STRING, message STRING, details MAP<STRING, STRING>")
    sinks.write_event_log(df, f"{tmp_path}/log")
    got = run(stores.read_event_log(spark, f"{tmp_path}/log", stream=True), "log_rows", "append", tmp_path)
    assert got.first().ts == T0


FEED = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{}</title><link>{}</link><description>{}</description></item>"


def test_ingest_stream(spark, tmp_path):
    sources = spark.createDataFrame(
        [("lo", "Lo", "u", True, None, 1, 1.0, 1.0, 0, 0, 0, None), ("hi", "Hi", "u", True, None, 9, 1.0, 1.0, 0, 0, 0, None)],
        "id STRING, name STRING, url STRING, enabled BOOLEAN, last_fetched_at TIMESTAMP, priority INT, weight DOUBLE, reliability_score DOUBLE, "
        "fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING",
    )
    sinks.write_next(sources, f"{tmp_path}/sources", 0)

    def land(source, name, text):
        (tmp_path / "in" / source).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / source / name).write_text(text, encoding="utf-8")

    def go():
        entries = feeds.read_feed_files(spark, f"{tmp_path}/in/*", stream=True)
        ingest.start_ingest(entries, f"{tmp_path}/articles", f"{tmp_path}/sources", f"{tmp_path}/ck").awaitTermination(120)
        articles = sinks.read_latest(spark, f"{tmp_path}/articles").collect()
        stats = sinks.read_latest(spark, f"{tmp_path}/sources").collect()
        return {r.original_url: r.content for r in articles}, {r.id: (r.fetch_count, r.success_count) for r in stats}

    land("lo", "1.xml", FEED.format(ITEM.format("Same", "http://a", "low") + ITEM.format("Solo", "http://s", "solo")))
    land("hi", "1.xml", FEED.format(ITEM.format("same", "http://a", "high")))
    articles, stats = go()
    assert articles == {"http://a": "high", "http://s": "solo"}
    assert stats == {"lo": (1, 1), "hi": (1, 1)}

    land("lo", "2.xml", "<rss><channel><item><title>cut")
    land("hi", "2.xml", FEED.format(ITEM.format("Same", "http://a", "changed") + ITEM.format("New", "http://n", "new")))
    articles, stats = go()
    assert articles == {"http://a": "high", "http://s": "solo", "http://n": "new"}
    assert stats == {"lo": (2, 1), "hi": (2, 2)}


def test_ingest_batch_can_run_again(spark, tmp_path):
    sources = spark.createDataFrame(
        [("s", "S", "u", True, None, 1, 1.0, 1.0, 0, 0, 0, None)],
        "id STRING, name STRING, url STRING, enabled BOOLEAN, last_fetched_at TIMESTAMP, priority INT, weight DOUBLE, reliability_score DOUBLE, "
        "fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING",
    )
    sinks.write_next(sources, f"{tmp_path}/sources", 0)
    (tmp_path / "in" / "s").mkdir(parents=True)
    (tmp_path / "in" / "s" / "f.xml").write_text(FEED.format(ITEM.format("T", "http://a", "body")))
    entries = feeds.read_feed_files(spark, f"{tmp_path}/in/*")
    for _ in range(2):
        ingest.ingest_batch(entries, 0, f"{tmp_path}/articles", f"{tmp_path}/sources")
    assert sinks.read_latest(spark, f"{tmp_path}/articles").count() == 1
    assert sinks.read_latest(spark, f"{tmp_path}/sources").first().fetch_count == 1
