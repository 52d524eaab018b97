"""Batches in any split give the groups and winners of one run, and write only what they touch."""

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import dedup, incremental, merge
from feedlake.sources import buckets, feeds
from feedlake.sources.buckets import BucketTable
from feedlake.streaming import remerge
from feedlake.streaming.remerge import ArticleStore

ITEM = (
    "arrival BIGINT, id STRING, source_id STRING, source_name STRING, source_priority INT, source_weight DOUBLE, "
    "source_reliability_score DOUBLE, title STRING, content STRING, url STRING, published_at TIMESTAMP"
)
ITEM_COLUMNS = [field.split()[0] for field in ITEM.split(", ")]


def items(spark, seed, n=60):
    """Few ids and titles, so groups meet through both; some without a title, some without an id."""
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["", *[f"d{rng.randrange(n // 3)}"] * 9]), f"s{i % 3}", "S", rng.randrange(1, 4), 1.0, 0.5 * (i % 3),
         rng.choice(["", *[f"Title  {rng.randrange(n // 3)}"] * 6]), f"c{i}", f"u{i}", None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ITEM)


def run(spark, tmp_path, rows, cuts, semantics):
    store = ArticleStore(str(tmp_path), 8)
    edges = [0, *cuts, 10**9]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        remerge.merge_items(store, rows.where(f"arrival >= {low} AND arrival < {high}"), n + 1, semantics=semantics)
    return store


@pytest.mark.parametrize("semantics,cuts", [("greedy", [20, 40]), ("transitive", [15, 40])])
def test_batches_give_the_groups_of_one_run(spark, tmp_path, semantics, cuts):
    rows = items(spark, len(cuts))
    store = run(spark, tmp_path, rows, cuts, semantics)
    named = rows.where("id <> ''")
    groups = dedup.group_duplicates(rows, semantics)
    best = merge.winners(named, groups).join(named.select("arrival", "id", "content"), "arrival")
    want = {tuple(r) for r in best.select("group_id", "arrival", "id", "content").collect()}
    got = {tuple(r) for r in store.articles.read(spark).select("group_id", "arrival", "id", "content").collect()}
    assert got == want
    keys = {r.key: r.label for r in store.keys.read(spark).collect()}
    moved = {r.label: r.into for r in store.moved.read(spark).collect()}
    for r in rows.join(groups, "arrival").collect():
        label = keys["i" + r.id]
        while label in moved:
            label = moved[label]
        if semantics == "transitive":
            assert label == r.group_id
        else:
            assert label <= r.group_id
    assert sorted(r.batch for r in store.runs.read(spark).collect()) == list(range(1, len(cuts) + 2))
    assert all(r.seconds > 0 for r in store.runs.read(spark).collect())
    ids = [r.id for r in store.current(spark).collect()]
    assert len(ids) == len(set(ids)) == len({r[2] for r in want})


def test_a_batch_writes_its_buckets_and_a_rerun_changes_nothing(spark, tmp_path):
    rows = items(spark, 9)
    store = run(spark, tmp_path, rows, [], "greedy")
    before = {t.path: t.manifest(spark) for t in store.tables()}
    one = spark.createDataFrame([(500, "new", "s1", "S", 1, 1.0, 1.0, "Never seen", "text", "u", None)], ITEM)
    written = remerge.merge_items(store, one, 2)
    assert len(written["articles"]) == 1 and len(written["keys"]) <= 2 and not written["moved"]
    after = store.articles.manifest(spark)
    old = before[store.articles.path]
    assert {b for b in after if after[b] != old.get(b)} == written["articles"]
    state = sorted(map(str, store.articles.read(spark).collect()))
    assert remerge.merge_items(store, one, 2) == written
    assert sorted(map(str, store.articles.read(spark).collect())) == state
    assert remerge.merge_items(store, one.withColumn("arrival", F.lit(501).cast("long")), 3)["articles"] == set()
    assert sorted(map(str, store.articles.read(spark).collect())) == state
    store.drop_unused(spark, 1)
    assert sorted(map(str, store.articles.read(spark).collect())) == state


def test_a_better_source_replaces_the_winner(spark, tmp_path):
    store = ArticleStore(str(tmp_path), 4)
    row = lambda n, i, rank, title: (n, i, "s", "S", rank, 1.0, 1.0, title, f"c{n}", "u", None)
    remerge.merge_items(store, spark.createDataFrame([row(0, "a", 1, "T"), row(1, "b", 1, "U")], ITEM), 1)
    remerge.merge_items(store, spark.createDataFrame([row(2, "c", 5, "t ")], ITEM), 2)
    got = {(r.group_id, r.id, r.batch) for r in store.articles.read(spark).collect()}
    assert got == {(0, "c", 2), (1, "b", 1)}
    remerge.merge_items(store, spark.createDataFrame([row(3, "b", 2, "T")], ITEM), 3, semantics="transitive")
    got = {(r.group_id, r.id, r.batch) for r in store.articles.read(spark).collect()}
    assert got == {(0, "c", 2)}
    remerge.merge_items(store, spark.createDataFrame([row(4, "z", 9, "U")], ITEM), 4, semantics="transitive")
    assert {(r.group_id, r.id) for r in store.articles.read(spark).collect()} == {(0, "z")}


def test_bucket_table(spark, tmp_path):
    table = BucketTable(str(tmp_path), "k", "k BIGINT, v STRING", 5)
    assert table.read(spark).count() == 0 and table.upsert(spark.createDataFrame([], "k BIGINT, v STRING"), 1) == set()
    table.upsert(spark.createDataFrame([(i, "a") for i in range(10)], "k BIGINT, v STRING"), 2)
    keys = spark.createDataFrame([(7,), (8,)], "k BIGINT")
    table.upsert(spark.createDataFrame([(7, "b")], "k BIGINT, v STRING"), 3, gone=spark.createDataFrame([(8,)], "k BIGINT"))
    assert {tuple(r) for r in table.lookup(keys).collect()} == {(7, "b")}
    assert {tuple(r) for r in table.lookup(keys, 3).collect()} == {(7, "a"), (8, "a")}
    assert table.read(spark).count() == 9
    assert [tuple(r) for r in table.get(spark, 7).collect()] == [(7, "b")]
    for k in range(10):
        table.upsert(spark.createDataFrame([], "k BIGINT, v STRING"), 4 + k, gone=spark.createDataFrame([(k,)], "k BIGINT"))
        if k % 5 == 4:
            table.drop_unused(spark, 1)
    assert table.read(spark).count() == 0 and table.manifest(spark) == {}


def test_texts_are_written_with_the_batch_and_with_the_store_only(spark, tmp_path, monkeypatch):
    stored = []

    def spy(module):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df: stored.append(df.columns) or plain(df))

    spy(remerge)
    spy(buckets)
    store = run(spark, tmp_path, items(spark, 3), [30], "transitive")
    assert [c for c in stored if "content" in c or "rewritten_content" in c] == [ITEM_COLUMNS] * 2
    runs = {r.batch: r.n_articles for r in store.runs.read(spark).collect()}
    assert sum(runs.values()) >= store.articles.read(spark).count() > 0


def test_a_repeated_arrival_gives_one_article(spark):
    rows = items(spark, 4, 6).coalesce(1)
    news = rows.select(F.col("arrival").alias("group_id"), "arrival")
    found = incremental.with_contents(news, rows.unionAll(rows)).collect()
    assert sorted((r.group_id, r.content) for r in found) == [(i, f"c{i}") for i in range(6)]


FEED = "<rss><channel>{}</channel></rss>"
ENTRY = "<item><title>{}</title><link>{}</link><description>{}</description></item>"


def test_stream_of_feed_files(spark, tmp_path):
    store = ArticleStore(f"{tmp_path}/store", 4)
    rows = [(s, s, "u", True, None, p, 1.0, 1.0, 0, 0, 0, None) for s, p in (("lo", 1), ("hi", 9))]
    store.sources.upsert(spark.createDataFrame(rows, remerge.SOURCES), 0)

    def land(source, name, text):
        (tmp_path / "in" / source).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / source / name).write_text(text, encoding="utf-8")

    def go():
        entries = feeds.read_feed_files(spark, f"{tmp_path}/in/*", stream=True)
        remerge.start_remerge(entries, store, f"{tmp_path}/ck").awaitTermination(120)
        stats = {r.id: (r.fetch_count, r.success_count) for r in store.sources.read(spark).collect()}
        return {r.url: r.content for r in store.current(spark).collect()}, stats

    land("lo", "1.xml", FEED.format(ENTRY.format("Same", "http://a", "low") + ENTRY.format("Solo", "http://s", "solo")))
    assert go() == ({"http://a": "low", "http://s": "solo"}, {"lo": (1, 1), "hi": (0, 0)})
    land("hi", "1.xml", FEED.format(ENTRY.format(" same", "http://b", "high") + ENTRY.format("New", "http://n", "new")))
    land("lo", "2.xml", "<rss><channel><item><title>cut")
    assert go() == ({"http://b": "high", "http://s": "solo", "http://n": "new"}, {"lo": (2, 1), "hi": (1, 1)})
