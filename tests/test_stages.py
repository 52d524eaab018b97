"""Content stages, providers and the ingest job."""

import pytest
from pyspark.sql import functions as F

from feedlake.functions import text as X
from feedlake.operators.enrich import call_with_retry, enrich_with_providers, rewrite_with_fallback
from feedlake.plans import jobs, stages
from feedlake.plans.stages import Stage
from feedlake.session import ship

ship(__name__)

ARTICLE = (
    "id STRING, source_id STRING, title STRING, content STRING, original_url STRING, published_at TIMESTAMP, "
    "rewritten_content STRING, rewrite_status STRING, published_outputs ARRAY<STRING>"
)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        ("1", "s", "<b>Great</b>  news", "<p>We  launch\n\n a new <i>AI</i> tool</p>", "u1", None, None, "pending", []),
        ("2", "s", "Bad", "down", "u2", None, None, "pending", []),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def good():
    return lambda prompt: "ok:" + prompt


def failing():
    def call(prompt):
        raise RuntimeError("down")

    return call


def picky():
    def call(prompt):
        if "down" in prompt:
            raise ValueError("no")
        return "picky"

    return call


def by_id(df):
    return {r.id: r for r in df.collect()}


def translation():
    return X.render_template("EN\n{text}", {"text": "rewritten_content"})


def edited(name):
    return X.render_template("Edited: {text}", {"text": name})


def test_default_stages(articles):
    steps = stages.default_stages(edited("content"), translation())
    r = by_id(stages.process_articles(articles, steps, F.lit(1.5), F.lit("2024-01-01").cast("timestamp")))["1"]
    assert (r.title, r.content) == ("Great news", "We launch\na new AI tool")
    assert r.rewritten_content == (
        "EN\nEdited: We launch\na new AI tool\n\nTags: #ai #news"
    )
    assert r.rewrite_status == "completed"
    run = r.pipeline_metadata.pipeline_run
    assert run.stages_executed == ["SanitizationStage", "RewriteStage", "TranslationStage", "ContentAnalysisStage", "MetadataTaggingStage"]
    assert (run.failures, run.duration_seconds, run.completed_at.year) == ([], 1.5, 2024)
    # The analysis sees the header the translation put in front.
    assert r.pipeline_metadata.intelligence.topics[:2] == ["great", "news"]


def test_analysis_can_be_disabled(articles):
    r = stages.process_articles(articles, stages.default_stages(analysis=False)).first()
    assert "intelligence" not in r.pipeline_metadata.asDict()
    assert "ContentAnalysisStage" in r.pipeline_metadata.pipeline_run.stages_executed


def test_plan_has_no_exchange_and_no_python(articles):
    plan = stages.process_articles(articles, stages.default_stages())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInPandas" not in plan


def test_critical_failure_ends_the_article_only(articles):
    steps = [stages.sanitize_stage(), stages.provider_stage({"p": picky}, retries=1), stages.translate_stage(translation()), stages.tagging_stage()]
    got = by_id(stages.process_articles(articles, steps))
    ok, failed = got["1"], got["2"]
    assert (ok.rewrite_status, ok.rewritten_content) == ("completed", "EN\npicky\n\nTags: #ai #news")
    assert (failed.rewrite_status, failed.rewritten_content) == ("failed", None)
    run = failed.pipeline_metadata.pipeline_run
    assert run.stages_executed == ["SanitizationStage", "RewriteStage"]
    assert [(f.stage, f.error, f.critical) for f in run.failures] == [("RewriteStage", "p: no", True)]


def test_non_critical_failure_falls_back_and_goes_on(articles):
    bad = F.when(F.col("id") == "2", F.lit("cannot"))
    steps = [
        Stage("Check", {"title": F.upper("title")}, critical=False, error=bad, fallback={"title": F.lit("fallback")}),
        Stage("Keep", {"content": F.lit("changed")}, critical=False, error=bad),
        stages.rewrite_stage(edited("content")),
    ]
    got = by_id(stages.process_articles(articles, steps))
    assert (got["2"].title, got["2"].content, got["2"].rewrite_status) == ("fallback", "down", "completed")
    assert [f.stage for f in got["2"].pipeline_metadata.pipeline_run.failures] == ["Check", "Keep"]
    assert got["1"].content == "changed" and got["1"].pipeline_metadata.pipeline_run.failures == []


def test_failover_order_and_errors(articles):
    got = by_id(enrich_with_providers(articles.select("id", "content"), "content", {"bad": failing, "good": good}, retries=2, delay=0.0))
    r = got["2"]
    assert (r.text, r.provider_used, r.attempts, r.errors) == ("ok:down", "good", 3, ["bad: down"])
    r = by_id(enrich_with_providers(articles.select("id", "content"), "content", {"bad": failing}, retries=1))["2"]
    assert (r.text, r.provider_used) == ("down", None)
    with pytest.raises(ValueError):
        enrich_with_providers(articles, "content", {}, retries=0)


def test_retry_waits_and_reraises():
    waits, calls = [], []

    def third(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("x")
        return text

    assert call_with_retry(third, "t", 3, 1.0, 2.0, waits.append) == ("t", 3)
    assert waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        call_with_retry(failing(), "t", 2, 1.0, 2.0, waits.append)
    assert waits == [1.0, 2.0, 1.0]


def test_rewrite_with_fallback(articles):
    got = by_id(rewrite_with_fallback(articles, "content", "content", {"p": picky}, retries=1))
    assert (got["1"].rewritten_content, got["1"].used_fallback) == ("picky", False)
    assert (got["2"].rewritten_content, got["2"].used_fallback) == ("[Rewritten Failed - Fallback]: down", True)


@pytest.fixture(scope="module")
def fetched(spark):
    entries = spark.createDataFrame(
        [(1, "lo", "Same", "http://x", "low"), (2, "hi", "same ", "http://x", "high"), (3, "hi", "Other", "http://y", "down"), (4, "hi", "Done", "http://z", "done")],
        "arrival BIGINT, source_id STRING, title STRING, link STRING, description STRING",
    ).withColumn("summary", F.lit(None).cast("string"))
    sources = spark.createDataFrame(
        [("lo", "Lo", "u", True, None, 1, 1.0, 1.0, 0, 0, 0, None), ("hi", "Hi", "u", True, None, 9, 1.0, 0.0, 0, 0, 0, "old")],
        "id STRING, name STRING, url STRING, enabled BOOLEAN, last_fetched_at TIMESTAMP, priority INT, weight DOUBLE, reliability_score DOUBLE, "
        "fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING",
    )
    log = spark.createDataFrame([("lo", None, False, "t/o"), ("hi", None, True, None)], "source_id STRING, ts TIMESTAMP, ok BOOLEAN, error STRING")
    from feedlake.functions.ids import article_id

    done = spark.createDataFrame(
        [("x", "old", "kept", "kept", "http://z", None, "kept", "completed", ["rss"])], ARTICLE
    ).withColumn("id", article_id("original_url"))
    return entries, sources, log, done


def at():
    return F.lit("2024-05-05").cast("timestamp")


def test_job(fetched):
    entries, sources, log, done = fetched
    result = jobs.fetch_and_process(entries, sources, done, log, at())
    got = {r.original_url: r for r in result.articles.collect()}
    assert set(got) == {"http://x", "http://y", "http://z"}
    assert (got["http://x"].content, got["http://x"].rewrite_status) == ("high", "completed")
    assert got["http://x"].rewritten_content == "Title: same \nContent: high"
    assert got["http://x"].published_outputs == ["eitaa", "pwa", "rss"]
    assert got["http://z"].title == "kept"
    stats = {r.id: (r.fetch_count, r.reliability_score, r.last_error) for r in result.sources.collect()}
    assert stats == {"lo": (1, 0.0, "t/o"), "hi": (1, 1.0, None)}


def test_job_twice_changes_nothing(fetched):
    entries, sources, log, done = fetched
    once = jobs.fetch_and_process(entries, sources, done, log, at()).articles
    again = jobs.fetch_and_process(entries, sources, once, log, F.lit("2030-01-01").cast("timestamp"))
    assert again.processed.count() == 0
    assert sorted(map(str, again.articles.collect())) == sorted(map(str, once.collect()))


def test_job_with_providers_and_with_stages(fetched):
    entries, sources, log, done = fetched
    rewrite = jobs.provider_rewrite({"p": picky}, retries=1)
    got = {r.original_url: r for r in jobs.fetch_and_process(entries, sources, done, log, at(), rewrite).processed.collect()}
    assert got["http://y"].used_fallback and got["http://y"].rewritten_content == "[Rewritten Failed - Fallback]: down"
    assert not got["http://x"].used_fallback
    staged = jobs.stages_rewrite([stages.provider_stage({"p": picky}, retries=1), stages.translate_stage(translation())])
    got = {r.original_url: r for r in jobs.fetch_and_process(entries, sources, done, log, at(), staged).processed.collect()}
    assert (got["http://y"].rewrite_status, got["http://y"].published_outputs) == ("failed", [])
    assert got["http://x"].rewritten_content == "EN\npicky"
