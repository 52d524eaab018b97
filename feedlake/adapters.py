"""Article, source, session and log tables derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.functions.ids import article_id

ROLES_BY_SEGMENT = {"MACHINERY": "admin"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a table whose file has too few splits to keep all cores busy.

    A table larger than one split per core is left alone: its scan is parallel enough.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 128 * 1024 * 1024
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def _minutes_after_epoch(minutes):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(mins=minutes)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed source per document source; ranks follow the numeric suffix, with ties."""
    names = read_table(spark, sf_dir, "documents").select("source").distinct()
    suffix = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    reliability = (suffix % 5) / F.lit(4.0)
    return names.select(
        F.col("source").alias("id"),
        F.concat(F.lit("Source "), "source").alias("name"),
        F.concat(F.lit("https://example.org/feeds/"), "source").alias("url"),
        (reliability > 0).alias("enabled"),
        F.lit(None).cast("timestamp_ntz").alias("last_fetched_at"),
        (suffix % 3 + 1).alias("priority"),
        (F.lit(1.0) + (suffix % 2) * F.lit(0.5)).alias("weight"),
        reliability.alias("reliability_score"),
        F.lit(0).cast("bigint").alias("fetch_count"),
        F.lit(0).cast("bigint").alias("success_count"),
        F.lit(0).cast("bigint").alias("failure_count"),
        F.lit(None).cast("string").alias("last_error"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed entries; every tenth pair of documents shares a link."""
    doc = F.col("doc_id")
    return documents(spark, sf_dir).select(
        doc.alias("arrival"),
        F.col("source").alias("source_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(
            F.lit("https://example.org/d/"),
            F.when(doc % 10 == 9, F.floor(doc / 2)).otherwise(doc).cast("string"),
        ).alias("link"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("summary"),
        _minutes_after_epoch(doc).alias("fetched_at"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all sources, each with its source's rank columns."""
    from feedlake.sources.feeds import to_raw_items

    sources = feed_sources(spark, sf_dir).withColumn("enabled", F.lit(True))
    return to_raw_items(feed_entries(spark, sf_dir), sources, F.col("fetched_at"))


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table: good documents are completed, toxic ones failed, others pending."""
    labels = read_table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    status = (
        F.when(F.col("quality") == 1, F.lit("completed"))
        .when(F.col("toxic") == 1, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    done = F.col("rewrite_status") == "completed"
    return (
        documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .select(
            doc.cast("string").alias("id"),
            F.col("source").alias("source_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://example.org/d/"), doc.cast("string")).alias("original_url"),
            _minutes_after_epoch(doc).alias("published_at"),
            status.alias("rewrite_status"),
        )
        .withColumn("rewritten_content", F.when(done, F.concat(F.lit("[edited] "), "title")))
        .withColumn("published_outputs", F.when(done, F.array(F.lit("pwa"), F.lit("rss"))).otherwise(F.array().cast("array<string>")))
    )


def web_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as articles."""
    pages = spread(read_table(spark, sf_dir, "pages"), "page_id")
    return pages.select(
        F.col("page_id"),
        article_id("url").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("content"),
        F.col("url").alias("original_url"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    role = F.when(segment == "MACHINERY", F.lit("admin")).when(segment != "FURNITURE", F.lit("viewer"))
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"), role.alias("role")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per sign-up, valid for a day; a zero-valued prop means it never expires."""
    endless = F.get_json_object("props", "$.k") == "0"
    return events(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("token"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(~endless, F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
        F.col("ts").alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log: the event type decides the path; errors carry no user."""
    kind = F.col("event_type")
    path = (
        F.when(kind == "view", F.concat(F.lit("/api/articles/"), F.col("event_id").cast("string")))
        .when(kind == "click", F.lit("/api/sources"))
        .when(kind == "purchase", F.lit("/api/stats"))
        .when(kind == "signup", F.lit("/health"))
        .otherwise(F.lit("/api/feed"))
    )
    return events(spark, sf_dir).select(
        F.col("event_id"), F.col("ts"), path.alias("path"),
        F.when(kind != "error", F.col("user_id").cast("string")).alias("user_id"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch per event, spread over the document sources by user."""
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        F.col("event_id"), F.col("ts"), (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"),
    )
