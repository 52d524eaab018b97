"""Feed files, stores, logs and sinks."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from feedlake.operators import render
from feedlake.plans import catalog
from feedlake.sources import feeds, sinks, stores

GOOD = """<rss><channel><title>feed</title>
<item><title>One &amp; two</title><link>http://a</link><description><![CDATA[<p>body</p>]]></description></item>
<item><title>Next</title></item></channel></rss>"""
BROKEN = "<rss><channel><item><title>ok</title></item><item><title>cut"


@pytest.fixture()
def feed_dir(tmp_path):
    for name, text in (("s1", GOOD), ("s2", BROKEN)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "feed.xml").write_text(text, encoding="utf-8")
    return tmp_path


def test_feed_files(spark, feed_dir):
    got = feeds.read_feed_files(spark, f"{feed_dir}/s1").collect()
    assert [(r.title, r.link, r.description) for r in got] == [("One & two", "http://a", "<p>body</p>"), ("Next", "", "")]


def test_atom_links(spark, tmp_path):
    text = (
        "<feed><entry><title>a</title><link rel='self' href='http://f'/><link rel='alternate' href='http://a'/></entry>"
        "<entry><title>b</title><link href='http://b'/></entry><entry><title>c</title><link rel='via' href='http://c'/></entry>"
        "<entry><title>d</title></entry></feed>"
    )
    (tmp_path / "atom.xml").write_text(text, encoding="utf-8")
    got = feeds.read_feed_files(spark, f"{tmp_path}/atom.xml", row_tag="entry").collect()
    assert {r.title: r.link for r in got} == {"a": "http://a", "b": "http://b", "c": "http://c", "d": ""}


def test_readable_entries_of_a_broken_file_stay(spark, feed_dir):
    entries = feeds.number_arrivals(feeds.read_feed_files(spark, f"{feed_dir}/*/feed.xml"), "file_path")
    good, broken, log = feeds.split_failed(entries)
    assert sorted(r.title for r in good.collect()) == ["Next", "One & two", "ok"]
    assert broken.count() >= 1
    got = {r.file_path.split("/")[-2]: (r.ok, r.error) for r in log.collect()}
    assert got == {"s1": (True, None), "s2": (True, "malformed feed document")}


def test_explode_feed_xml(spark):
    df = spark.createDataFrame([("s1", GOOD), ("s3", "<rss><channel></channel></rss>")], "source_id STRING, body STRING")
    got = feeds.explode_feed_xml(df, "body", "source_id").orderBy("pos").collect()
    assert [(r.source_id, r.pos, r.title, r.link, r.description) for r in got] == [
        ("s1", 0, "One & two", "http://a", "<p>body</p>"), ("s1", 1, "Next", "", ""),
    ]


def test_raw_items_take_fetch_time_and_first_content(spark):
    entries = spark.createDataFrame(
        [(1, "on", "t", "http://identical.url", "", "sum"), (2, "on", None, None, "desc", "sum"), (3, "off", "t", "u", "d", None), (4, "on", "t", "u", None, None)],
        "arrival INT, source_id STRING, title STRING, link STRING, description STRING, summary STRING",
    )
    sources = spark.createDataFrame(
        [("on", "On", True, None, None, None), ("off", "Off", False, 1, 1.0, 1.0)],
        "id STRING, name STRING, enabled BOOLEAN, priority INT, weight DOUBLE, reliability_score DOUBLE",
    )
    got = feeds.to_raw_items(entries, sources, F.lit("2024-01-01").cast("timestamp")).orderBy("arrival").collect()
    assert [(r.id, r.title, r.content, r.source_priority) for r in got] == [
        ("de70a7094d1697cd", "t", "sum", 1), ("e3b0c44298fc1c14", "", "desc", 1), (got[2].id, "t", "", 1),
    ]
    assert got[0].published_at.year == 2024


def test_number_arrivals(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 4)], "s STRING, n INT")
    got = [r.s for r in feeds.number_arrivals(df, "s").orderBy("arrival").collect()]
    assert got == ["a", "a", "b", "c"]


def test_json_store(spark, tmp_path):
    store = {
        "feed_sources": {"s": {"id": "s", "name": "S", "url": "u", "last_fetched_at": "bad"}},
        "articles": {"a": {"id": "a", "title": "T", "published_at": "2024-01-01T00:00:00", "published_outputs": ["rss"]}},
    }
    (tmp_path / "store.json").write_text(json.dumps(store, indent=2))
    (tmp_path / "broken.json").write_text("[1, 2")
    source = stores.read_json_store(spark, f"{tmp_path}/store.json", "feed_sources").first()
    assert (source.id, source.enabled, source.priority, source.reliability_score, source.last_fetched_at) == ("s", True, 1, 1.0, None)
    article = stores.read_json_store(spark, f"{tmp_path}/store.json", "articles").first()
    assert (article.rewrite_status, article.published_outputs, article.published_at.day) == ("pending", ["rss"], 1)
    assert stores.read_json_store(spark, f"{tmp_path}/store.json", "users").count() == 0
    assert stores.read_json_store(spark, f"{tmp_path}/broken.json", "articles").count() == 0


def test_event_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "x", "error", "m", "text", {"k": "v"})],
        "ts STRING, event_type STRING, severity STRING, module STRING, message STRING, details MAP<STRING, STRING>",
    ).withColumn("ts", F.to_timestamp("ts"))
    sinks.write_event_log(df, f"{tmp_path}/log")
    sinks.write_event_log(df, f"{tmp_path}/log")
    got = stores.read_event_log(spark, f"{tmp_path}/log").collect()
    assert len(got) == 2
    assert (got[0].severity, got[0].details, got[0].ts.hour, got[0].timestamp) == ("ERROR", {"k": "v"}, 10, "2024-01-01T10:00:00Z")
    assert stores.scan_table(spark, "/root/testdata/sf0.001/nation.parquet").count() > 0


ARTICLE = (
    "id STRING, source_id STRING, title STRING, content STRING, original_url STRING, published_at TIMESTAMP, "
    "rewritten_content STRING, rewrite_status STRING, published_outputs ARRAY<STRING>"
)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        ("a", "s", "عنوان <&>", "plain", "http://u", "2026-08-12 10:00:00", "", "completed", ["pwa"]),
        ("b", "s", "Older", "original", "", "2026-08-11 10:00:00", None, "pending", None),
    ]
    return spark.createDataFrame(rows, ARTICLE.replace("TIMESTAMP", "STRING")).withColumn("published_at", F.to_timestamp("published_at"))


def test_json_feed(spark, articles, tmp_path):
    path = f"{tmp_path}/feed"
    for expected in (2, 0):
        assert sinks.write_json_feed(articles.limit(expected), path, "now") == expected
        manifest = sinks.read_feed_manifest(spark, path)
        assert (manifest["version"], manifest["count"], manifest["generated_at"]) == ("1.0", expected, "now")
        items = sorted((json.loads(r["item"]) for r in sinks.read_json_feed(spark, path).collect()), key=lambda i: i["id"])
        assert len(items) == expected
        if expected:
            a, b = items
            assert (a["title"], a["content"], a["url"], a["published_outputs"]) == ("عنوان <&>", "", "http://u", ["pwa"])
            assert (b["content"], b["url"], b["published_outputs"], b["pipeline_metadata"]) == ("original", "", [], {})
            assert a["published_at"] == "2026-08-12T10:00:00+00:00"
            assert len(a) == 10


def test_feeds_hold_every_article(spark, tmp_path):
    many = spark.range(250).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("2024-01-01").alias("published_at"))
    assert sinks.write_json_feed(many, f"{tmp_path}/j", "now") == 250
    assert sinks.write_rss_feed(many, f"{tmp_path}/r", "T", "l", "D", "now") == 250
    assert sinks.read_json_feed(spark, f"{tmp_path}/j").count() == 250
    assert sinks.read_rss_feed(spark, f"{tmp_path}/r").select("guid").distinct().count() == 250


def test_rss_feed(spark, articles, tmp_path):
    path = f"{tmp_path}/feed"
    for expected in (2, 0):
        sinks.write_rss_feed(articles.limit(expected), path, "T & t", "http://l", "D", "now")
        manifest = sinks.read_feed_manifest(spark, path)
        assert (manifest["title"], manifest["link"], manifest["count"]) == ("T & t", "http://l", expected)
        text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "feed" / manifest["items"]).glob("part-*"))
        items = ET.fromstring(f"<channel>{text}</channel>").findall("item")
        items.sort(key=lambda i: i.findtext("guid"))
        assert len(items) == expected == sinks.read_rss_feed(spark, path).count()
        if expected:
            assert items[0].findtext("title") == "عنوان <&>"
            assert items[0].findtext("pubDate") == "Wed, 12 Aug 2026 10:00:00 GMT"
            assert items[0].find("guid").attrib == {"isPermaLink": "false"}
            assert items[1].findtext("guid") == "b"


def test_dates_as_text_and_other_zones(spark, articles):
    rows = [("a", "2026-08-12T12:00:00+02:00"), ("b", "soon"), ("c", None)]
    texts = spark.createDataFrame(rows, "id STRING, published_at STRING").withColumn("title", F.lit("t"))
    now = F.lit("2026-01-01T00:00:00Z").cast("timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for session in ("UTC", "Asia/Tehran"):
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            dates = {r.guid: r.pubDate for r in render.rss_fields(texts, now).collect()}
            assert dates["a"] == "Wed, 12 Aug 2026 10:00:00 GMT"
            assert dates["b"] == dates["c"] == "Thu, 01 Jan 2026 00:00:00 GMT"
            shown = {r.id: r.published_at for r in render.feed_items(texts).collect()}
            assert shown == {"a": "2026-08-12T10:00:00", "b": None, "c": None}
            instants = texts.where("id = 'a'").withColumn("published_at", F.to_timestamp("published_at"))
            assert render.feed_items(instants).first().published_at == "2026-08-12T10:00:00+00:00"
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def test_newest_bounds_the_feed(articles):
    assert [r.id for r in sinks.newest(articles, 1).collect()] == ["a"]


def test_channel_messages(articles):
    got = {r.id: r.body for r in render.channel_messages(articles, "@c*~", "content").collect()}
    assert got["a"] == "chat_id=%40c%2A~&text=plain"


def test_publish_outputs(articles):
    got = {r.id: r.published_outputs for r in render.publish_outputs(articles, {"x": F.lit(True), "y": F.lit(False), "z": F.lit(None).cast("boolean")}).collect()}
    assert got == {"a": ["x"], "b": []}


def test_fan_out(articles):
    def broken(_):
        raise OSError("disk")

    seen = []
    got = sinks.fan_out(articles, {"bad": broken, "good": lambda df: seen.append(df.count())}).collect()
    assert [(r.target, r.ok, r.error) for r in got] == [("bad", False, "OSError: disk"), ("good", True, None)]
    assert seen == [2]


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.read_latest(spark, path, "id INT").count() == 0
    for n in range(1, 5):
        assert sinks.write_next(spark.range(n), path, keep=2) == n - 1
    assert sinks.read_latest(spark, path).count() == 4
    assert sinks.read_latest(spark, path, below=3).count() == 3
    assert sinks.versions(spark, path) == [1, 2, 3]


def test_landed_feed_files_follow_the_documents(spark, tmp_path):
    """Far apart ids do not make a file each, and every document is read back."""
    rows = [(i * 10_000, f"text {i} & <b>", None if i % 3 == 0 else f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    good, broken, log = catalog._landed_feeds(spark, str(tmp_path))
    assert log.count() == 3
    assert sorted((int(r.link), r.title) for r in good.collect()) == [(i, t) for i, t, _ in rows]
    assert broken.count() == 0


def test_numbering_reads_its_entries_once(spark):
    """Finding the ranges of the sort does not parse the entries again."""
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for r in rows:
            seen.add(1)
            yield r

    df = spark.createDataFrame(spark.range(100).rdd.mapPartitions(look), "id LONG")
    assert feeds.number_arrivals(df, "id").count() == 100
    assert seen.value == 100
