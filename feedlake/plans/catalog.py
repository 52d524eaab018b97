"""Named queries over the benchmark tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake import adapters as T
from feedlake.functions import analytics as A, text as X
from feedlake.functions.ids import article_id
from feedlake.functions.masking import mask_sensitive
from feedlake.functions.responses import extract_completion
from feedlake.functions.timestamps import iso_text, parse_iso
from feedlake.operators import dedup, enrich, merge, monitoring as mon, render, tables
from feedlake.operators.analysis import add_agent_signals, analyze
from feedlake.operators.enrich import enrich_with_providers
from feedlake.operators.sources import update_source_stats
from feedlake.operators.throttle import throttle
from feedlake.plans import jobs, stages
from feedlake.session import checkpoint_dir, ship
from feedlake.sources import feeds, pages, sinks
from feedlake.sources.sinks import COMMIT_IN_TASKS, write_event_log
from feedlake.sources.stores import read_event_log, read_json_store
from feedlake.sources.buckets import BucketTable
from feedlake.streaming import admission, rollups, summaries
from feedlake.streaming.remerge import ArticleStore, merge_items

ship(__name__)

Query = Callable[[SparkSession, str], DataFrame]

# The documents hold invented words, so the queries use word lists made of frequent
# fragments of them; with the default lists every count would be zero.
POSITIVE = ["ing", "ble", "tion", "the", "er"]
NEGATIVE = ["ther", "thon", "of", "le", "und"]
PERSIAN_STANDIN = ["que", "les", "des", "nicht", "sch"]
STOP = ["the", "and", "ing", "tion", "des", "les"]
WEIGHTS = {"tionst": 0.3, "quer": 0.5, "thanea": 0.4, "enlich": 0.3, "queeux": 0.4}
KEYWORDS = {"ai": ["ai", "llm"], "tech": ["thanea", "python"], "news": ["release", "attion"]}


def _edited(text: str = "text") -> Column:
    return X.render_template("Edited: {text}", {"text": text})


# --- ingestion, duplicates, merging ------------------------------------------------


def aggregate_sources_priority(spark, sf):
    return merge.aggregate_sources(T.raw_items(spark, sf), "priority", "greedy")


def aggregate_sources_transitive(spark, sf):
    return merge.aggregate_sources(T.raw_items(spark, sf), "priority", "transitive")


def aggregate_sources_combine(spark, sf):
    return merge.aggregate_sources(T.raw_items(spark, sf), "combine", "greedy")


def aggregate_sources_pieces(spark, sf):
    return merge.aggregate_sources(T.raw_items(spark, sf), "pieces", "greedy")


def combined_pieces(spark, sf):
    """The combined texts in pieces, as a group of any size has them."""
    items = T.raw_items(spark, sf)
    return merge.combine_pieces(items, dedup.group_duplicates(items)).select("group_id", "position", "piece")


def _by_title(spark, sf):
    """Items and their groups when only titles count."""
    items = T.raw_items(spark, sf)
    return items, dedup.group_duplicates(items.withColumn("id", F.col("arrival").cast("string")))


def merge_by_title_priority(spark, sf):
    items, groups = _by_title(spark, sf)
    merged = merge.merge_priority(items, groups)
    return merged.select(X.normalize_title("title").alias("group_key"), "id", "source_id", "content")


def merge_by_title_combine(spark, sf):
    items, groups = _by_title(spark, sf)
    merged = merge.merge_combine(items, groups)
    return merged.select(X.normalize_title("title").alias("group_key"), "id", "source_id", "content")


def duplicate_groups(spark, sf):
    return dedup.group_duplicates(T.raw_items(spark, sf))


def duplicate_report(spark, sf):
    items = T.raw_items(spark, sf)
    return dedup.duplicate_report(items, dedup.group_duplicates(items))


def dedup_exact(spark, sf):
    docs = T.read_table(spark, sf, "documents")
    return dedup.dedup_exact(docs, "text", "doc_id").select("doc_id", "content_sha")


def article_ids(spark, sf):
    links = T.feed_entries(spark, sf).select(F.col("link").alias("url"))
    pages = T.read_table(spark, sf, "pages").select("url")
    return links.unionByName(pages).select(article_id("url").alias("id"), "url")


def enabled_sources(spark, sf):
    return feeds.enabled_sources(T.feed_sources(spark, sf)).select("id", "name", "priority", "weight", "reliability_score")


def raw_items(spark, sf):
    """Entries of the enabled sources only."""
    entries, sources = T.feed_entries(spark, sf), T.feed_sources(spark, sf)
    items = feeds.to_raw_items(entries, sources, F.col("fetched_at"))
    return items.withColumn("published_at", iso_text("published_at"))


def clean_items(spark, sf):
    return merge.clean_items(T.raw_items(spark, sf))


def source_stats(spark, sf):
    stats = update_source_stats(T.feed_sources(spark, sf), T.fetch_log(spark, sf), "event_id")
    return stats.select(
        "id", "enabled", "fetch_count", "success_count", "failure_count", "reliability_score", "last_error",
        iso_text("last_fetched_at").alias("last_fetched_at"),
    )


def feed_xml_entries(spark, sf):
    """Each document as a one-item feed held in a column, then parsed back."""
    xml = F.concat(
        F.lit("<rss><channel><item><title>"), _escaped(X.normalize_whitespace("text")), F.lit("</title><link>https://example.org/d/"),
        F.col("doc_id").cast("string"), F.lit("</link></item></channel></rss>"),
    )
    held = T.documents(spark, sf).select("doc_id", xml.alias("xml"))
    return feeds.explode_feed_xml(held, "xml", "doc_id")


def feed_item_shapes(spark, sf):
    """Documents as feeds of five shapes: RSS, cut in its second item, no markup, RDF, and items without a channel."""
    doc, title = F.col("doc_id"), X.normalize_whitespace("text")
    item = lambda n, end="</item>": F.concat(
        F.lit("<item><title>"), _escaped(title), F.lit(f"</title><link>https://example.org/{n}/"), doc.cast("string"),
        F.lit("</link><description><![CDATA[<item>"), F.substring(title, 1, 20), F.lit(f"</item>]]></description>{end}"))
    shape = doc % 5
    xml = (
        F.when(shape == 0, F.concat(F.lit("<rss><channel><!-- <item> -->"), item(1), item(2), F.lit("</channel></rss>")))
        .when(shape == 1, F.concat(F.lit("<rss><channel>"), item(1), item(2, "")))
        .when(shape == 2, F.concat(F.lit("no feed "), _escaped(title)))
        .when(shape == 3, F.concat(F.lit("<rdf:RDF><channel/>"), item(1), F.lit("<item rdf:about='x'/></rdf:RDF>")))
        .otherwise(F.concat(F.lit("<rss>"), item(1), F.lit("<item><title>open</item></rss>")))
    )
    read = feeds.read_feed_items(T.documents(spark, sf).select("doc_id", xml.alias("xml")), "xml", "doc_id")
    return read.drop("broken")


def _remerged(spark, sf, semantics):
    """The items as three batches, in order; the stored winner of every group."""
    items = T.raw_items(spark, sf)
    store = ArticleStore(f"{checkpoint_dir(spark)}/articles-{uuid.uuid4().hex}", 16)
    low, high = items.select(F.min("arrival"), F.max("arrival")).first()
    edges = [low + (high - low + 1) * n // 3 for n in range(4)] if low is not None else []
    for n, (begin, end) in enumerate(zip(edges, edges[1:])):
        merge_items(store, items.where((F.col("arrival") >= begin) & (F.col("arrival") < end)), n + 1, semantics=semantics)
    return store.articles.read(spark).select("group_id", "arrival", "id", "source_id", "title", "content", "url")


def remerged_articles(spark, sf):
    return _remerged(spark, sf, "greedy")


def remerged_articles_transitive(spark, sf):
    return _remerged(spark, sf, "transitive")


# --- text ---------------------------------------------------------------------------


def normalize_text(spark, sf):
    docs = T.documents(spark, sf)
    return docs.select(
        "doc_id",
        X.normalize_whitespace("text").alias("text_norm"),
        X.normalize_title(F.substring_index("text", "\n", 1)).alias("title_norm"),
    )


def sanitize_pages(spark, sf):
    pages = T.web_articles(spark, sf)
    return pages.select(
        "page_id", X.sanitize_title("title").alias("title_clean"), X.sanitize_content("content").alias("content_clean")
    )


def sanitize_documents(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.sanitize_content("text").alias("content_clean"))


def render_template(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.prompt(F.substring_index("text", "\n", 1), "text").alias("prompt"))


def prefix_templates(spark, sf):
    """Two templates of the caller's own."""
    return T.read_table(spark, sf, "conversations").select(
        "conv_id", "turn", _edited().alias("prefixed"), X.render_template("Turn {turn}: {text}", {"turn": F.col("turn").cast("string"), "text": "text"}).alias("processed")
    )


def summary_template(spark, sf):
    """The first line over the whole text, by a template of the caller's own."""
    title = F.substring_index("text", "\n", 1)
    return T.documents(spark, sf).select(
        "doc_id", X.render_template("About {title}\n{content}", {"title": title, "content": "text"}).alias("summary")
    )


def rewrite_fallback(spark, sf):
    """Assistant turns answer; every other turn counts as a failed rewrite of its text."""
    answer = F.when(F.col("role") == "assistant", _edited())
    return T.read_table(spark, sf, "conversations").select(
        "conv_id", "turn", X.rewrite_or_fallback(answer, "text").alias("text"), answer.isNull().alias("used_fallback")
    )


def header_and_tags(spark, sf):
    tags = X.tag_keywords("title", "content", KEYWORDS)
    tagged = T.stored_articles(spark, sf).withColumn("tags", tags)
    text = F.col("rewritten_content")
    headed = tagged.withColumn("rewritten_content", F.when(X.is_filled(text), X.render_template("EN\n{text}", {"text": text})).otherwise(text))
    return headed.select(
        "id", F.array_join("tags", ",").alias("tags"), X.append_tags("rewritten_content", "tags").alias("rewritten_content")
    )


def extract_completions(spark, sf):
    """Turns wrapped into model responses: chat for assistants, echoed generation for users, errors for systems."""
    turns = T.spread(T.read_table(spark, sf, "conversations"), "conv_id")
    prompt = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(":"))
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    chat = F.to_json(F.struct(F.array(message).alias("choices")))
    echo = F.to_json(F.array(F.struct(F.concat(prompt, F.lit("\n "), "text").alias("generated_text"))))
    failed = F.to_json(F.struct(F.col("text").alias("error")))
    role = F.col("role")
    body = F.when(role == "assistant", chat).when(role == "user", echo).otherwise(failed)
    bodies = turns.select("conv_id", "turn", "role", prompt.alias("prompt"), body.alias("body"))
    read = bodies.withColumn(
        "r",
        F.when(role == "assistant", extract_completion("body", "chat")).otherwise(
            extract_completion("body", "generation", "prompt")
        ),
    )
    return read.select("conv_id", "turn", "r.text", "r.error")


def mask_props(spark, sf):
    value = F.get_json_object("props", "$.k")
    named = T.events(spark, sf).select(
        "event_id",
        F.struct(
            value.alias("api_key"),
            F.col("event_type").alias("kind"),
            F.create_map(F.lit("Token"), value, F.lit("plain"), value).alias("extra"),
            F.array(F.struct(value.alias("db_password"), F.col("user_id").alias("key_id"))).alias("items"),
        ).alias("config"),
    )
    c = F.col("config")
    return mask_sensitive(named).select(
        "event_id",
        c["api_key"].alias("api_key"),
        c["kind"].alias("kind"),
        c["extra"]["Token"].alias("extra_token"),
        c["extra"]["plain"].alias("extra_plain"),
        c["items"][0]["db_password"].alias("item_password"),
        c["items"][0]["key_id"].alias("item_key_id"),
    )


# --- analytics ------------------------------------------------------------------------


def tokens(spark, sf):
    words = T.documents(spark, sf).select("doc_id", X.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


def language(spark, sf):
    docs = T.documents(spark, sf)
    return docs.select(
        "doc_id",
        A.persian_share("text").alias("letter_share"),
        A.detect_language("text").alias("language"),
        A.detect_language("text", persian=PERSIAN_STANDIN).alias("language_by_list"),
    )


def sentiment(spark, sf):
    scored = T.documents(spark, sf).select("doc_id", A.analyze_sentiment("text", positive=POSITIVE, negative=NEGATIVE).alias("s"))
    hits = F.col("s.details")
    return scored.select(
        "doc_id",
        hits["positive_hits"].alias("positive_hits"),
        hits["negative_hits"].alias("negative_hits"),
        A.sentiment_ratio(hits["positive_hits"], hits["negative_hits"]).alias("ratio"),
        F.col("s.score").alias("score"),
        F.col("s.label").alias("label"),
    )


def readability(spark, sf):
    return T.documents(spark, sf).select("doc_id", A.analyze_readability("text").alias("r")).select("doc_id", "r.*")


def topics(spark, sf):
    return T.documents(spark, sf).select("doc_id", F.array_join(A.extract_topics("text", english=STOP), ",").alias("topics"))


def topics_corpus(spark, sf):
    """How many documents of a language have a term among their topics."""
    terms = T.documents(spark, sf).select("lang", F.explode(A.extract_topics("text", english=STOP)).alias("term"))
    return terms.groupBy("lang", "term").agg(F.count("*").alias("n"))


def agent_signals(spark, sf):
    """Triggers in order priorities (default lists) and in documents (fragment lists)."""
    orders = T.spread(T.read_table(spark, sf, "orders"), "o_orderkey").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("text"),
    )
    docs = T.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    by_default = orders.withColumn("score", A.analyze_sentiment("text")["score"])
    by_fragments = docs.withColumn("score", A.analyze_sentiment("text", positive=POSITIVE, negative=NEGATIVE)["score"])
    signalled = add_agent_signals(by_default, F.col("text"), F.col("score"), "s").unionByName(
        add_agent_signals(by_fragments, F.col("text"), F.col("score"), "s", WEIGHTS)
    )
    return signalled.select(
        "id", "s.priority", "s.relevance_score", "s.dispatch_route", "s.confidence",
        F.array_join("s.matched_triggers", ",").alias("matched_triggers"),
    )


def _analyzed(spark, sf):
    """Title and content as stored: the title is the first line, so its words count twice."""
    docs = T.documents(spark, sf).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return analyze(docs, positive=POSITIVE, negative=NEGATIVE, weights=WEIGHTS)


def analyze_documents(spark, sf):
    i = F.col("intelligence")
    return _analyzed(spark, sf).select(
        "doc_id",
        i["language"].alias("language"),
        i["sentiment"]["score"].alias("score"),
        i["sentiment"]["label"].alias("label"),
        i["readability"]["words_count"].alias("words_count"),
        i["readability"]["sentences_count"].alias("sentences_count"),
        F.array_join(i["topics"], ",").alias("topics"),
        i["agent_signals"]["priority"].alias("priority"),
        i["agent_signals"]["dispatch_route"].alias("dispatch_route"),
    )


def analyze_quality_join(spark, sf):
    """Sentiment labels by document quality. Only id and label enter the join."""
    labels = T.read_table(spark, sf, "labels").select("doc_id", "quality")
    label = A.analyze_sentiment("text", positive=POSITIVE, negative=NEGATIVE)["label"]
    found = T.documents(spark, sf).select("doc_id", label.alias("label"))
    return found.join(labels, "doc_id").groupBy("quality", "label").agg(F.count("*").alias("n"))


# --- tables ---------------------------------------------------------------------------

ARTICLE_COLUMNS = ["id", "source_id", "title", "content", "original_url", "published_at", "rewrite_status", "rewritten_content"]


def _target(spark, sf):
    return T.stored_articles(spark, sf).select(*ARTICLE_COLUMNS)


def _updates(spark, sf):
    """A new write of every labelled article, and one for every web page."""
    labelled = T.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    stored = _target(spark, sf).join(labelled, "id")
    again = stored.select(
        "id",
        F.lit("desk").alias("source_id"),
        F.concat("title", F.lit(" (2)")).alias("title"),
        "content",
        F.concat("original_url", F.lit("?v=2")).alias("original_url"),
        (F.col("published_at") + F.expr("INTERVAL 1 DAY")).alias("published_at"),
        F.lit("completed").alias("rewrite_status"),
        F.concat(F.lit("[again] "), "title").alias("rewritten_content"),
    )
    pages = T.web_articles(spark, sf).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.lit("web").alias("source_id"),
        "title",
        "content",
        "original_url",
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("published_at"),
        F.lit("pending").alias("rewrite_status"),
        F.lit(None).cast("string").alias("rewritten_content"),
    )
    return again.unionByName(pages)


def upsert_full(spark, sf):
    return tables.upsert(_target(spark, sf), _updates(spark, sf), "id")


def upsert_partial(spark, sf):
    columns = [c for c in tables.ARTICLE_UPDATE_COLUMNS if c in ARTICLE_COLUMNS]
    return tables.upsert_partial(_target(spark, sf), _updates(spark, sf), "id", columns)


def delete_by_key(spark, sf):
    """Articles without those labelled toxic."""
    toxic = T.read_table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return tables.delete_by_key(_target(spark, sf), toxic, "id").select("id", "title", "rewrite_status")


def skip_completed(spark, sf):
    articles = T.stored_articles(spark, sf)
    items = articles.select("id", "source_id", "title")
    return tables.skip_completed(items, articles)


def get_article(spark, sf):
    return tables.get_by_key(_target(spark, sf), "id", "7")


def list_articles(spark, sf):
    listed = tables.list_articles(T.stored_articles(spark, sf))
    return listed.withColumn("published_outputs", F.array_join("published_outputs", ","))


def list_feed(spark, sf):
    return tables.list_feed(T.stored_articles(spark, sf))


def list_sources(spark, sf):
    return tables.list_sources(T.feed_sources(spark, sf)).select("id", "url", "name", "enabled", "priority", "weight", "reliability_score", "fetch_count")


def paginate_articles(spark, sf):
    page = tables.paginate(T.stored_articles(spark, sf), page=3, limit=10, order_by="id")
    return page.withColumn("published_at", iso_text("published_at"))


def indexed_pages(spark, sf):
    """The third and the last page of all articles by one stored index."""
    articles = T.stored_articles(spark, sf)
    index = pages.PageIndex(f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", "id")
    total = index.build(articles)
    last = max(1, -(-total // 10))
    both = [index.page(articles, n).withColumn("page", F.lit(n)) for n in (3, last)]
    return both[0].unionByName(both[1]).select("page", "id", "title", "content", iso_text("published_at").alias("published_at"), "rewrite_status", "total")


def paginate_after(spark, sf):
    return tables.paginate_after(_target(spark, sf), "2", limit=10, order_by="id").select("id", "title")


def article_stats(spark, sf):
    return tables.article_stats(T.stored_articles(spark, sf), T.feed_sources(spark, sf))


def status_breakdown(spark, sf):
    return tables.status_breakdown(T.stored_articles(spark, sf))


def find_user(spark, sf):
    return tables.find_user(T.users(spark, sf), "Customer#000000042")


def scan_users(spark, sf):
    return T.users(spark, sf)


def evolve_schema(spark, sf):
    """Old sources without statistics get the defaults."""
    old = T.feed_sources(spark, sf).select("id", "name", F.nullif("priority", F.lit(2)).alias("priority"))
    return tables.evolve_schema(
        old, {"priority": F.lit(1), "weight": F.lit(1.0), "fetch_count": F.lit(0).cast("bigint"), "enabled": F.lit(True)}
    )


def valid_sessions(spark, sf):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    live = tables.valid_sessions(T.sessions(spark, sf), T.users(spark, sf), at)
    return live.select("token", "user_id", "username", "role", iso_text("expires_at").alias("expires_at"))


def authorize_requests(spark, sf):
    checked = tables.authorize(T.requests(spark, sf), T.users(spark, sf))
    return checked.select("event_id", "path", "permission", "status")


def check_unique(spark, sf):
    return tables.check_unique(T.stored_articles(spark, sf), "title")


def parse_timestamps(spark, sf):
    """Event times as text in three shapes, one of them broken, read back."""
    kind = F.col("event_type")
    shape = (
        F.when(kind == "error", F.lit("not a time"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    written = T.events(spark, sf).select("event_id", shape.alias("written"))
    default = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return written.select(
        "event_id",
        iso_text(parse_iso("written")).alias("parsed"),
        iso_text(parse_iso("written", default)).alias("parsed_or_default"),
    )


# --- monitoring -----------------------------------------------------------------------


def _samples(spark, sf):
    """Event values as metric samples, exact to the cent."""
    return T.events(spark, sf).select(
        F.col("event_type").alias("name"), F.col("value").cast("decimal(12,2)").alias("value"), "ts", "event_id"
    )


def _errors(spark, sf):
    return T.events(spark, sf).where("event_type = 'error'").select(
        F.concat(F.lit("part"), (F.col("user_id") % 7).cast("string")).alias("component"),
        F.lit("EventError").alias("type"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
        "ts",
        "event_id",
    )


def metric_counters(spark, sf):
    return mon.metric_counters(_samples(spark, sf)).withColumn("value", F.col("value").cast("double"))


def metric_gauges(spark, sf):
    return mon.metric_gauges(_samples(spark, sf), "event_id").withColumn("value", F.col("value").cast("double"))


def timing_summary(spark, sf):
    return mon.timing_summary(_samples(spark, sf), "event_id")


def error_summary(spark, sf):
    return mon.error_summary(_errors(spark, sf), "event_id").select(
        F.coalesce("component", F.lit("(all)")).alias("component"),
        "errors_total",
        F.col("last_error.type").alias("last_type"),
        F.col("last_error.message").alias("last_message"),
        iso_text("last_error.timestamp").alias("last_at"),
    )


def event_log(spark, sf):
    log = mon.event_log(
        T.events(spark, sf).select(
            "event_id", "ts", "event_type",
            F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")).alias("severity"),
            F.lit("shop").alias("module"),
            F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("message"),
            F.from_json("props", "map<string,string>").alias("details"),
        )
    )
    return log.select("timestamp", "event_type", "severity", "module", "message", F.col("details")["k"].alias("detail_k"))


def event_rollup_hourly(spark, sf):
    return mon.event_rollup(T.events(spark, sf))


def _job_runs(spark, sf):
    """Each user's events as runs of a job; the value is the duration in seconds."""
    seconds = F.col("value").cast("decimal(18,6)")
    return T.events(spark, sf).select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("name"),
        F.lit(300.0).alias("interval_s"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("end"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.lit("EventError: failed")).alias("error"),
        "event_id",
    )


def _shown_runs(done: DataFrame, *more: str) -> DataFrame:
    return done.select(
        "name", *more, "run_count", "success_count", "failure_count", "last_status", "last_error", "last_duration",
        iso_text("last_run_end").alias("last_run_end"), iso_text("next_run").alias("next_run"),
    )


def job_runs(spark, sf):
    return _shown_runs(mon.job_run_summary(_job_runs(spark, sf), "event_id"))


def dashboard(spark, sf):
    """The one-record summary, unfolded into its metrics."""
    one = mon.dashboard_summary(_samples(spark, sf), _errors(spark, sf), "event_id")
    return one.select("status", F.size("error_details").alias("n_error_details"), F.explode("metrics").alias("name", "value"))


def dashboard_rows(spark, sf):
    """The dashboard with a row per name, for any number of them."""
    rows = mon.dashboard_rows(_samples(spark, sf), _errors(spark, sf), "event_id")
    return rows.select("name", "value", F.col("last_error.message").alias("last_error"))


def throttle_one_per_hour(spark, sf):
    events = T.events(spark, sf).select("event_id", "ts", F.col("user_id").alias("key"))
    return throttle(events, limit=1, window_s=3600)


def throttle_three_per_day(spark, sf):
    events = T.events(spark, sf).select("event_id", "ts", F.col("user_id").alias("key"))
    return throttle(events, limit=3, window_s=86_400)


def rolling_request_count(spark, sf):
    events = T.events(spark, sf).select("event_id", "ts", F.col("user_id").alias("key"))
    return mon.rolling_request_count(events, window_s=3600)


# --- stages, publishing, the job --------------------------------------------------------


def content_stages(spark, sf):
    """The default stages over every article, with word lists that occur."""
    articles = T.stored_articles(spark, sf).withColumns(
        {"rewritten_content": F.lit(None).cast("string"), "rewrite_status": F.lit("pending")}
    )
    steps = [
        stages.sanitize_stage(),
        stages.rewrite_stage(_edited("content")),
        stages.translate_stage(X.render_template("EN\n{text}", {"text": "rewritten_content"})),
        stages.analysis_stage(positive=POSITIVE, negative=NEGATIVE, weights=WEIGHTS),
        stages.tagging_stage(KEYWORDS),
    ]
    done = stages.process_articles(articles, steps)
    meta = F.col("pipeline_metadata")
    return done.select(
        "id", "title", "content", "rewritten_content", "rewrite_status",
        F.array_join(meta["pipeline_run"]["stages_executed"], ",").alias("stages_executed"),
        F.size(meta["pipeline_run"]["failures"]).alias("n_failures"),
        meta["intelligence"]["language"].alias("language"),
        meta["intelligence"]["readability"]["words_count"].alias("words_count"),
        meta["intelligence"]["sentiment"]["label"].alias("label"),
    )


def _accepted() -> dict[str, Column]:
    """Channel answers that vary by article."""
    return {
        "eitaa": F.length("title") > 100,
        "pwa": F.lit(True),
        "rss": F.col("source_id") != "src3",
    }


def publish_outputs(spark, sf):
    sent = render.publish_outputs(T.stored_articles(spark, sf), _accepted())
    return sent.select("id", F.array_join("published_outputs", ",").alias("published_outputs"))


def json_feed_items(spark, sf):
    """Items read back out of their JSON text."""
    items = render.json_items(T.stored_articles(spark, sf))
    parts = ["id", "source_id", "title", "content", "original_url", "url", "published_at", "rewrite_status"]
    fields = ", ".join(f"{p} STRING" for p in parts)
    read = items.select(F.from_json("item", f"{fields}, published_outputs ARRAY<STRING>").alias("i"))
    return read.select(*[F.col(f"i.{p}").alias(p) for p in parts], F.size("i.published_outputs").alias("n_outputs"))


def json_feed_files(spark, sf):
    """The published feed of all articles, read back from its files."""
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    n = sinks.write_json_feed(T.stored_articles(spark, sf), path, "2024-06-01T00:00:00+00:00")
    read = sinks.read_json_feed(spark, path).select(F.from_json("item", "id STRING, title STRING, content STRING, published_at STRING").alias("i"))
    return read.select("i.*", F.lit(n).cast("long").alias("n_articles"))


def rss_feed_files(spark, sf):
    """The RSS feed of all articles, read back from its files."""
    path = f"{checkpoint_dir(spark)}/rss-{uuid.uuid4().hex}"
    n = sinks.write_rss_feed(T.stored_articles(spark, sf), path, "News", "https://example.org", "All articles", "now")
    return sinks.read_rss_feed(spark, path).withColumn("n_articles", F.lit(n).cast("long"))


def rss_feed_pages(spark, sf):
    """The feed of all articles in pages a reader can open, newest first, each page parsed on its own."""
    path = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    articles = T.stored_articles(spark, sf)
    pages.write_rss_pages(articles, path, "https://example.org/feed", "News", "https://example.org", "All articles", "now", page_items=50)
    return feeds.read_feed_items(pages.read_pages(spark, path), "document", "page")


def json_feed_pages(spark, sf):
    """The same pages as JSON documents, with their neighbours and items."""
    path = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_json_pages(T.stored_articles(spark, sf), path, "https://example.org/feed", "now", page_items=50)
    schema = "count BIGINT, next STRING, previous STRING, items ARRAY<STRUCT<id: STRING, title: STRING>>"
    read = pages.read_pages(spark, path).select("page", F.from_json("document", schema).alias("d"))
    return read.select("page", "d.count", "d.next", "d.previous", F.posexplode("d.items").alias("pos", "item")).select(
        "page", "count", "next", "previous", "pos", "item.id", "item.title")


def fan_out_targets(spark, sf):
    """Articles handed to two feeds and a failing target; what the feeds hold is read back."""
    base = f"{checkpoint_dir(spark)}/fan-{uuid.uuid4().hex}"

    def failing(df):
        raise OSError("no space")

    targets = {
        "full": lambda df: sinks.write_json_feed(df, f"{base}/full", "now"),
        "broken": failing,
        "done": lambda df: sinks.write_json_feed(df.where("rewrite_status = 'completed'"), f"{base}/done", "now"),
    }
    answers = sinks.fan_out(T.stored_articles(spark, sf), targets)
    held = None
    for name in ("full", "done"):
        ids = sinks.read_json_feed(spark, f"{base}/{name}").select(F.lit(name).alias("target"), F.get_json_object("item", "$.id").alias("id"))
        held = ids if held is None else held.unionByName(ids)
    return answers.join(held, "target", "left").select("target", "ok", "error", "id")


def rewrite_with_fallback(spark, sf):
    """Turns rewritten by two providers in order; where both fail the marked original stays."""
    turns = T.spread(T.read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id")
    asked = turns.withColumn("question", F.col("text")).withColumnRenamed("text", "content")
    done = enrich.rewrite_with_fallback(asked, "question", "content", {"terse": _terse, "patient": _patient}, retries=2, delay=0.0)
    return done.select("conv_id", "turn", "rewritten_content", "used_fallback")


def rss_items(spark, sf):
    return render.rss_fields(T.stored_articles(spark, sf))


def channel_messages(spark, sf):
    return render.channel_messages(T.stored_articles(spark, sf), "news~room*1", "content")


def fetch_and_process(spark, sf):
    """One run of the job over all entries, on top of what the store holds as completed.

    The store is keyed like the items here, by the id of the link.
    """
    entries, sources = T.feed_entries(spark, sf), T.feed_sources(spark, sf).withColumn("enabled", F.lit(True))
    stored = T.stored_articles(spark, sf).withColumn("id", article_id("original_url"))
    result = jobs.fetch_and_process(
        entries, sources, stored, T.fetch_log(spark, sf).select("source_id", "ts", "ok", "error"),
        F.col("fetched_at"), channels=_accepted(),
    )
    return result.articles.select(
        "id", "source_id", "title", "rewrite_status", "rewritten_content", "original_url",
        F.array_join("published_outputs", ",").alias("published_outputs"),
    )


# --- providers, failing stages, files, streams --------------------------------------------


def _terse():
    """Answers short turns only."""

    def call(text: str) -> str:
        if len(text) > 300:
            raise ValueError("too long")
        return "terse: " + text

    return call


def _patient():
    def call(text: str) -> str:
        if "." not in text:
            raise ValueError("no sentence")
        return "patient: " + text

    return call


def enrich_failover(spark, sf):
    """Two providers in order; turns neither takes come back unchanged."""
    turns = T.spread(T.read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id")
    asked = turns.withColumnRenamed("text", "question")
    answered = enrich_with_providers(asked, "question", {"terse": _terse, "patient": _patient}, retries=2, delay=0.0)
    return answered.select(
        "conv_id", "turn", "text", "provider_used", "attempts", F.array_join("errors", "; ").alias("errors")
    )


def stage_isolation(spark, sf):
    """A check toxic articles fail without harm, and a rewrite that ends pending articles of one source."""
    articles = T.stored_articles(spark, sf)
    toxic = F.when(F.col("rewrite_status") == "failed", F.lit("toxic"))
    refused = F.when((F.col("rewrite_status") == "pending") & (F.col("source_id") == "src3"), F.lit("refused"))
    steps = [
        stages.Stage("Check", {"title": F.upper("source_id")}, critical=False, error=toxic),
        stages.Stage("Rewrite", {"rewritten_content": F.col("title")}, error=refused),
        stages.Stage("Close", {"rewrite_status": F.lit("completed")}),
    ]
    done = stages.run_stages(articles, steps)
    failures = F.transform("pipeline_run.failures", lambda f: F.concat(f["stage"], F.lit(":"), f["error"], F.lit(":"), f["critical"].cast("string")))
    return done.select(
        "id", "title", "rewritten_content", "rewrite_status",
        F.array_join("pipeline_run.stages_executed", ",").alias("stages_executed"),
        F.array_join(failures, ",").alias("failures"),
    )


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


FILE_ENTRIES = 1_000


def _land(items: DataFrame, spot: list[str], head: Column, end: Column) -> str:
    """Write ``value`` lines to one file per ``spot``, between a head and an end; the folder's path."""
    files = items.select(*spot).distinct()
    lines = items.select(*spot, F.lit(1).alias("line"), "value")
    for at, value in ((0, head), (2, end)):
        lines = lines.unionByName(files.select(*spot, F.lit(at).alias("line"), value.alias("value")))
    landed = lines.repartition(*spot).sortWithinPartitions(*spot, "line").drop("line")
    path = f"{checkpoint_dir(items.sparkSession)}/feeds-{uuid.uuid4().hex}"
    landed.write.option(*COMMIT_IN_TASKS).partitionBy(*spot).text(path)
    return path


def _landed_feeds(spark, sf):
    """All documents landed as feed files, a few per source, with one source's files cut off, and read."""
    clean = _escaped(X.normalize_whitespace("text"))
    item = F.concat(F.lit("<item><title>"), clean, F.lit("</title><link>"), F.col("doc_id").cast("string"), F.lit("</link></item>"))
    docs = T.read_table(spark, sf, "documents")
    # Files of one source hold about FILE_ENTRIES documents each, so their number follows the documents.
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / FILE_ENTRIES).alias("_files"))
    items = docs.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", F.pmod(F.xxhash64("doc_id"), "_files").alias("bucket"), item.alias("value")
    )
    end = F.when(F.col("source") == "src7", F.lit("<item><title>cut")).otherwise(F.lit("</channel></rss>"))
    path = _land(items, ["source", "bucket"], F.lit("<rss><channel>"), end)
    entries = feeds.number_arrivals(feeds.read_feed_files(spark, f"{path}/*/*"), "file_path")
    return feeds.split_failed(entries)


def _landed_source() -> Column:
    return F.regexp_extract("file_path", "source=([^/]+)", 1).alias("source_id")


def feed_files(spark, sf):
    """Entries read back out of feed files; those of cut off files included."""
    good, _, _ = _landed_feeds(spark, sf)
    return good.select(_landed_source(), F.col("link").alias("doc"), "title")


def feed_errors(spark, sf):
    """Sources with broken fragments, and whether their fetches still count as successes."""
    _, broken, log = _landed_feeds(spark, sf)
    sources = broken.select(_landed_source()).distinct()
    logged = log.groupBy(_landed_source()).agg(F.min("ok").alias("ok"), F.max("error").alias("error"))
    return sources.join(logged, "source_id")


def atom_entries(spark, sf):
    """Pages as an Atom feed whose links are attributes, some beside a link to the feed, read back."""
    pages = T.read_table(spark, sf, "pages")
    own = F.concat(F.lit('<link href="'), _escaped(F.col("url")), F.lit('"/>'))
    feed = F.when(F.col("page_id") % 2 == 0, F.lit('<link rel="self" href="https://example.org/feed"/>')).otherwise(F.lit(""))
    title = F.concat(F.lit("<title>"), F.col("page_id").cast("string"), F.lit("</title>"))
    items = pages.select(
        F.floor(F.col("page_id") / FILE_ENTRIES).alias("bucket"), F.concat(F.lit("<entry>"), title, feed, own, F.lit("</entry>")).alias("value")
    )
    path = _land(items, ["bucket"], F.lit("<feed>"), F.lit("</feed>"))
    entries = feeds.read_feed_files(spark, f"{path}/*", row_tag="entry")
    return entries.select(F.col("title").alias("page"), "link")


def json_store_users(spark, sf):
    """Users written as JSON store documents, a bounded number in each, and read back with defaults."""
    users = T.users(spark, sf).withColumn("created_at", F.lit("2024-01-01T00:00:00Z"))
    record = F.struct("id", F.struct("id", "username", "role", "created_at"))
    documents = users.groupBy(F.floor(F.col("id").cast("long") / FILE_ENTRIES).alias("document")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(record)).alias("users"))).alias("value")
    )
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    documents.write.partitionBy("document").text(path)
    read = read_json_store(spark, f"{path}/*", "users")
    return read.select("id", "username", "role", iso_text("created_at").alias("created_at"))


def event_log_round_trip(spark, sf):
    path = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    write_event_log(
        T.events(spark, sf).select(
            "ts", "event_type", F.lit("warning").alias("severity"), F.lit("shop").alias("module"),
            F.col("event_id").cast("string").alias("message"), F.from_json("props", "map<string,string>").alias("details"),
        ),
        path,
    )
    log = read_event_log(spark, path)
    return log.select("message", "event_type", "severity", F.col("details")["k"].alias("k"), iso_text("ts").alias("at"))


def _stream(spark, sf, name):
    """A stream over a table that is one file or a folder of files; the pattern suits both."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run_stream(df: DataFrame) -> DataFrame:
    """Everything that is there, through a file sink, in append mode."""
    base = f"{checkpoint_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def dedup_stream(spark, sf):
    docs = _stream(spark, sf, "documents").select(
        "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id"))).alias("ts")
    )
    return _run_stream(rollups.dedup_stream(docs, "text", within="3650 days").select("content_sha"))


def event_rollup_stream(spark, sf):
    """Hourly counts of all windows, the open ones included, as the stream left them."""
    timed = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rollups.start_updates(rollups.event_rollup_stream(timed), f"{base}/out", f"{base}/state").awaitTermination()
    counts = rollups.latest_updates(spark, f"{base}/out", ["window_start", "event_type"])
    return counts.withColumn("window_start", iso_text("window_start"))


def _three_batches(spark, rows: DataFrame, ts: str, what: str, start) -> str:
    """Land ``rows`` in three parts by time and run ``start(stream, path, checkpoint)`` after each; the path."""
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.select(F.min(at), F.max(at)).first()
    for n in range(3 if low is not None else 0):
        begin, end = (low + (high - low + 1) * k // 3 for k in (n, n + 1))
        rows.where((at >= begin) & (at < end)).write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return f"{path}/out"


def source_stats_stream(spark, sf):
    """Source statistics kept by a stream of three micro-batches."""
    log, summary = T.fetch_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), summaries.fetch_summary()
    out = _three_batches(spark, log, "ts", "fetches", summary.start)
    stats = summaries.source_stats_of(summary.state(out).read(spark), T.feed_sources(spark, sf))
    return stats.select(
        "id", "enabled", "fetch_count", "success_count", "failure_count", "reliability_score", "last_error",
        iso_text("last_fetched_at").alias("last_fetched_at"), summaries.LATE,
    )


def job_runs_stream(spark, sf):
    """Job states kept by a stream of three micro-batches."""
    runs = _job_runs(spark, sf).withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    summary = summaries.run_summary()
    out = _three_batches(spark, runs, "end", "runs", summary.start)
    return _shown_runs(summaries.job_runs_of(summary.state(out).read(spark)), summaries.LATE)


def throttle_stream(spark, sf):
    """Three requests a day and user, answered by a stream of three micro-batches; one row per request."""
    events = T.events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"))

    def start(stream, path, checkpoint):
        return admission.start_admission(stream, path, checkpoint, limit=3, window_s=86_400)

    answers = admission.read_answers(spark, _three_batches(spark, events, "ts", "requests", start))
    return answers.withColumn("key", F.col("key").cast("bigint"))


def stored_article(spark, sf):
    """One article out of a table stored in key buckets: one bucket is opened."""
    articles = T.stored_articles(spark, sf).select("id", "title", "content", "rewrite_status")
    store = BucketTable(
        f"{checkpoint_dir(spark)}/by-id-{uuid.uuid4().hex}", "id", "id STRING, title STRING, content STRING, rewrite_status STRING", 64)
    store.upsert(articles, 1)
    return store.get(spark, "7")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        aggregate_sources_priority, aggregate_sources_transitive, aggregate_sources_combine, aggregate_sources_pieces,
        combined_pieces,
        merge_by_title_priority, merge_by_title_combine, duplicate_groups, duplicate_report, dedup_exact,
        article_ids, enabled_sources, raw_items, clean_items, source_stats, feed_xml_entries,
        normalize_text, sanitize_pages, sanitize_documents, render_template, prefix_templates, summary_template,
        rewrite_fallback, header_and_tags, extract_completions, mask_props,
        tokens, language, sentiment, readability, topics, topics_corpus, agent_signals, analyze_documents,
        analyze_quality_join,
        upsert_full, upsert_partial, delete_by_key, skip_completed, get_article, list_articles, list_feed,
        list_sources, paginate_articles, indexed_pages, paginate_after, article_stats, status_breakdown, find_user, scan_users,
        evolve_schema, valid_sessions, authorize_requests, check_unique, parse_timestamps,
        metric_counters, metric_gauges, timing_summary, error_summary, event_log, event_rollup_hourly, job_runs,
        dashboard, dashboard_rows, throttle_one_per_hour, throttle_three_per_day, rolling_request_count,
        content_stages, publish_outputs, json_feed_items, json_feed_files, rss_items, rss_feed_files, rss_feed_pages, json_feed_pages, fan_out_targets,
        rewrite_with_fallback, channel_messages, fetch_and_process,
        enrich_failover, stage_isolation, feed_files, feed_errors, atom_entries, json_store_users, event_log_round_trip, dedup_stream, event_rollup_stream,
        feed_item_shapes, remerged_articles, remerged_articles_transitive, source_stats_stream, job_runs_stream, throttle_stream, stored_article,
    )
}
