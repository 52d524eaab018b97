"""Analyses against their rules restated in plain Python."""

import pytest
from pyspark.sql import functions as F

from feedlake.functions import analytics as A, lexicons as lex
from feedlake.operators.analysis import analyze


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s STRING").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, expected",
    [
        ("این یک متن فارسی است که باید شناسایی شود", "fa"),
        ("This is an English sentence about software", "en"),
        ("Das ist ein deutscher Satz", "en"),
        ("", "en"),
        (None, "en"),
        ("abcdefghijklmnopqrstuvwxyzabcdefghij از به", "fa"),
        ("the abcdefghijklmnopqrstuvwxyzabcdefghij از", "en"),
    ],
)
def test_language(spark, text, expected):
    assert one(spark, text, A.detect_language("s")) == expected


@pytest.mark.parametrize(
    "text, score, label, hits",
    [
        ("a great day", 1.0, "positive", (1, 0)),
        ("great but bad", 0.0, "neutral", (1, 1)),
        ("nothing here", 0.0, "neutral", (0, 0)),
        ("", 0.0, "neutral", (0, 0)),
        (" ".join(["Good"] * 31 + ["BAD"] * 9), 0.55, "positive", (31, 9)),
        (" ".join(["good"] * 23 + ["bad"] * 20), 0.07, "neutral", (23, 20)),
        (" ".join(["good"] * 2 + ["error"] * 7), -0.56, "negative", (2, 7)),
        ("WİN wİn", 0.0, "neutral", (0, 0)),
    ],
)
def test_sentiment(spark, text, score, label, hits):
    v = one(spark, text, A.analyze_sentiment("s"))
    assert (v.score, v.label, tuple(v.details)) == (score, label, hits)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("This is a simple sentence. And this is another one.", (10, 2, 4.2, 3)),
        ("", (0, 0, 0.0, 0)),
        ("   ", (0, 0, 0.0, 0)),
        ("...", (1, 1, 3.0, 1)),
        ("one! two? three۔ four", (4, 4, 4.5, 1)),
        ("w " * 203, (203, 1, 1.0, 60)),
    ],
)
def test_readability(spark, text, expected):
    assert tuple(one(spark, text, A.analyze_readability("s"))) == expected


def test_readability_seconds_keep_double_order(spark):
    counts = spark.range(1, 3000).withColumn("s", F.repeat(F.lit("w "), F.col("id").cast("int")))
    for r in counts.select("id", A.analyze_readability("s").alias("v")).collect():
        assert r.v.estimated_reading_time_seconds == max(int((r.id / 200) * 60), 1)


@pytest.mark.parametrize(
    "text, lang, expected",
    [
        ("beta alpha beta alpha gamma", "en", ["beta", "alpha", "gamma"]),
        ("the 123 456 ab cat the", "en", ["cat"]),
        ("f1 e1e d1d c1c b1b a1a zzz zzz", "en", ["zzz", "e1e", "d1d", "c1c", "b1b"]),
        ("", "en", []),
        ("برای خبر خبر ایران", "fa", ["خبر", "ایران"]),
    ],
)
def test_topics(spark, text, lang, expected):
    assert one(spark, text, A.extract_topics("s", F.lit(lang))) == expected


def test_topics_limit(spark):
    assert one(spark, "one one two three", A.extract_topics("s", limit=1)) == ["one"]


def signals(text, score):
    found = [w for w in lex.URGENCY_WEIGHTS if w in text.lower()]
    total = 0.0
    for w in found:
        total += lex.URGENCY_WEIGHTS[w]
    urgency, impact = min(total, 0.5), abs(score) * 0.2
    priority = round(min(0.2 + urgency + impact, 1.0), 2)
    route = "publish_immediately" if priority >= 0.7 else "review_required" if priority >= 0.4 else "standard_processing"
    return priority, round(min(0.3 + urgency + impact, 1.0), 2), route, round(0.5 + urgency * 0.5 + impact * 0.5, 2), found


def test_agent_signals(spark):
    texts = ["Breaking: critical security exploit", "breakthrough", "Warnings", "calm", "urgent alert"]
    rows = [(t, i / 100) for t in texts for i in range(-100, 101)]
    df = spark.createDataFrame(rows, "s STRING, x DOUBLE")
    for r in df.select("s", "x", A.agent_signals("s", F.col("x")).alias("v")).collect():
        assert tuple(r.v) == signals(r.s, r.x)
    v = one(spark, "Breaking: critical security exploit", A.agent_signals("s", F.lit(-0.8)))
    assert (v.priority, v.dispatch_route) == (0.86, "publish_immediately")
    v = one(spark, "", A.agent_signals("s", F.lit(0.0)))
    assert tuple(v) == (0.0, 0.0, "standard_processing", None, [])


def test_analyze_uses_language_and_rounded_score(spark):
    df = spark.createDataFrame([("Great launch", None), (None, "خبر مهم برای ایران خبر")], "title STRING, content STRING")
    a, b = [r.intelligence for r in analyze(df).collect()]
    assert (a.sentiment.score, a.topics, a.readability.words_count) == (1.0, ["great", "launch"], 2)
    assert (b.language, b.topics[0], b.agent_signals.dispatch_route) == ("fa", "خبر", "standard_processing")


def test_analyze_has_no_exchange(spark):
    df = spark.range(5).selectExpr("'a' AS title", "'b' AS content")
    plan = analyze(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_analysis_looks_words_up_in_one_pass(spark):
    """The word lists are searched once for all counts; the counts are those of separate passes."""
    df = spark.createDataFrame([("a", "the İ good از bad 12 ٣ the café café good"), ("", ""), (None, None)], "title STRING, content STRING")
    done = analyze(df)
    filters = done._jdf.queryExecution().optimizedPlan().toString().count("filter(_words")
    assert filters == 1
    for row in done.select("intelligence", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("t")).withColumns(
        {"s": A.analyze_sentiment("t"), "l": A.detect_language("t"), "k": A.extract_topics("t")}
    ).collect():
        assert (row.intelligence.sentiment, row.intelligence.language, row.intelligence.topics) == (row.s, row.l, row.k)
