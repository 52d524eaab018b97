"""Upserts, lookups, listings, sessions and permissions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlake.functions.masking import mask_sensitive
from feedlake.functions.timestamps import iso_text, parse_iso, rfc822
from feedlake.operators import tables
from feedlake.operators.sources import update_source_stats


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(
        [("a", "s1", "A", "2024-01-01", "pending"), ("b", "s1", "B", "2024-01-02", "completed")],
        "id STRING, source_id STRING, title STRING, published_at STRING, rewrite_status STRING",
    )


@pytest.fixture(scope="module")
def updates(spark):
    return spark.createDataFrame(
        [("a", "s9", "A2", "2030-01-01", None, 1), ("a", "s9", "A3", "2031-01-01", "failed", 2), ("c", "s9", "C", "2030-01-03", "pending", 1)],
        "id STRING, source_id STRING, title STRING, published_at STRING, rewrite_status STRING, seq INT",
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_replaces_everything_with_the_last_write(store, updates):
    assert rows(tables.upsert(store, updates, "id", "seq")) == [
        ("a", "s9", "A3", "2031-01-01", "failed"), ("b", "s1", "B", "2024-01-02", "completed"), ("c", "s9", "C", "2030-01-03", "pending"),
    ]


def test_upsert_partial_keeps_first_values(store, updates):
    assert rows(tables.upsert_partial(store, updates, "id", order="seq")) == [
        ("a", "s1", "A3", "2024-01-01", "failed"), ("b", "s1", "B", "2024-01-02", "completed"), ("c", "s9", "C", "2030-01-03", "pending"),
    ]
    to_null = updates.where("seq = 1 AND id = 'a'").drop("seq")
    assert tables.upsert_partial(store, to_null, "id").where("id = 'a'").first().rewrite_status is None


def test_delete_get_and_find(spark, store):
    assert rows(tables.delete_by_key(store, spark.createDataFrame([("a",), ("zz",)], "id STRING"), "id").select("id")) == [("b",)]
    assert tables.get_by_key(store, "id", "b").count() == 1
    assert tables.get_by_key(store, "id", "B").count() == 0
    users = spark.createDataFrame([("1", "Ann"), ("2", "ann")], "id STRING, username STRING")
    assert [r.id for r in tables.find_user(users, "ann").collect()] == ["2"]


def test_skip_completed(spark, store):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("", 4), (None, 5)], "id STRING, n INT")
    assert rows(tables.skip_completed(items, store)) == [("a", 1), ("c", 3)]


def test_paginate(spark):
    df = spark.range(25).select("id", F.lit("t").alias("title"))
    page = tables.paginate(df, 3, 10).collect()
    assert [(r.id, r.total) for r in page] == [(i, 25) for i in range(20, 25)]
    assert tables.paginate(df, 4, 10).count() == 0
    with pytest.raises(ValueError):
        tables.paginate(df, 0, 10)
    assert [r.id for r in tables.paginate_after(df, 19, 3).collect()] == [20, 21, 22]


def test_pages_come_in_order_at_any_depth(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit("t").alias("title"))
    for page, limit in ((1, 10), (13, 37), (27, 37), (28, 37), (50, 37), (1, 2000)):
        got = [r.id for r in tables.paginate(df, page, limit).collect()]
        assert got == list(range(1000))[(page - 1) * limit: page * limit]


def test_stats(spark, store):
    sources = spark.range(3)
    assert tuple(tables.article_stats(store, sources).first()) == (2, 1, 3)
    assert rows(tables.status_breakdown(store)) == [("completed", 1), ("pending", 1)]
    assert rows(tables.check_unique(store, "source_id")) == [("s1", 2)]


def test_evolve_schema(spark):
    df = spark.createDataFrame([("a", None), ("b", 3)], "id STRING, priority INT")
    got = tables.evolve_schema(df, {"priority": F.lit(1), "weight": F.lit(1.0)})
    assert rows(got) == [("a", 1, 1.0), ("b", 3, 1.0)]


def test_sessions(spark):
    at = dt.datetime(2024, 1, 1, 12)
    sessions = spark.createDataFrame(
        [("never", "u", None), ("past", "u", at - dt.timedelta(seconds=1)), ("now", "u", at), ("orphan", "x", None)],
        "token STRING, user_id STRING, expires_at TIMESTAMP",
    )
    users = spark.createDataFrame([("u", "ann", "viewer")], "id STRING, username STRING, role STRING")
    got = tables.valid_sessions(sessions, users, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert sorted(r.token for r in got.collect()) == ["never", "now"]


def test_authorize(spark):
    users = spark.createDataFrame([("a", "admin"), ("v", "viewer"), ("n", None), ("o", "other")], "id STRING, role STRING")
    cases = [
        ("/health", None, 200), ("/api/articles", None, 401), ("/api/articles/7", "v", 200), ("/api/articles", "zz", 401),
        ("/api/sources", "v", 403), ("/api/sources", "a", 200), ("/api/stats", "n", 200), ("/api/scheduler", "n", 403),
        ("/api/feed", "o", 403), ("/api/articlesX", None, 200), ("/api/articles/", "a", 200),
    ]
    requests = spark.createDataFrame(cases, "path STRING, user_id STRING, expected INT")
    for r in tables.authorize(requests, users).collect():
        assert r.status == r.expected, r


def test_timestamps(spark):
    texts = ["2026-08-12T10:00:00", "2026-08-12T10:00:00Z", "2026-08-12T12:00:00+02:00", "2026-08-12T10:00:00.250", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    ts = parse_iso("t")
    got = [tuple(r) for r in df.select(iso_text(ts), rfc822(ts)).collect()]
    ten = ("2026-08-12T10:00:00", "Wed, 12 Aug 2026 10:00:00 GMT")
    assert got == [ten, ten, ten, ("2026-08-12T10:00:00.250000", ten[1]), (None, None), (None, None)]
    fallback = df.select(iso_text(parse_iso("t", F.lit("2000-01-01").cast("timestamp"))).alias("v")).collect()
    assert [r.v for r in fallback][-2:] == ["2000-01-01T00:00:00"] * 2


def test_masking(spark):
    df = spark.createDataFrame(
        [("k", "p", 80, None, ("g", "open"), [("d", 1)], {"api_token": "x", "plain": "y"}, {"n": {"secret": "z"}}, ("deep",), "")],
        "api_key STRING, password STRING, port INT, token STRING, nested STRUCT<github_token: STRING, kind: STRING>, "
        "list_data ARRAY<STRUCT<db_password: STRING, n: INT>>, m MAP<STRING, STRING>, mm MAP<STRING, MAP<STRING, STRING>>, "
        "secret_box STRUCT<password: STRING>, empty_key STRING",
    )
    r = mask_sensitive(df).first()
    mask = "********"
    assert (r.api_key, r.password, r.port, r.token) == (mask, mask, 80, None)
    assert tuple(r.nested) == (mask, "open")
    assert [tuple(x) for x in r.list_data] == [(mask, 1)]
    assert r.m == {"api_token": mask, "plain": "y"}
    assert r.mm == {"n": {"secret": mask}}
    assert tuple(r.secret_box) == ("deep",)
    assert r.empty_key == mask
    assert mask_sensitive(df, mask_empty=False).first().empty_key == ""


def test_source_stats(spark):
    base = dt.datetime(2024, 1, 1)
    sources = spark.createDataFrame(
        [("good", True, 1.0, 0, 0, 0, "old", None), ("bad", True, 1.0, 0, 0, 0, None, base), ("off", False, 0.5, 4, 2, 2, "x", None), ("idle", True, 0.5, 4, 2, 2, "x", None)],
        "id STRING, enabled BOOLEAN, reliability_score DOUBLE, fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING, last_fetched_at TIMESTAMP",
    )
    later = base + dt.timedelta(hours=1)
    log = spark.createDataFrame(
        [("good", base, False, "boom"), ("good", later, True, None), ("bad", later, False, "Timeout"), ("off", later, True, None)],
        "source_id STRING, ts TIMESTAMP, ok BOOLEAN, error STRING",
    )
    got = {r.id: tuple(r)[2:] for r in update_source_stats(sources, log).collect()}
    assert got == {
        "good": (0.5, 2, 1, 1, None, later), "bad": (0.0, 1, 0, 1, "Timeout", base),
        "off": (0.5, 4, 2, 2, "x", None), "idle": (0.5, 4, 2, 2, "x", None),
    }
