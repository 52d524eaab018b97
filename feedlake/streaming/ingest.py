"""The ingest job over a stream of landed feed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.plans.jobs import Rewrite, fetch_and_process, template_rewrite
from feedlake.sources.feeds import number_arrivals, split_failed
from feedlake.sources.sinks import read_latest, write_next

ARTICLE_SCHEMA = (
    "id STRING, source_id STRING, title STRING, content STRING, original_url STRING, published_at TIMESTAMP, "
    "rewritten_content STRING, rewrite_status STRING, published_outputs ARRAY<STRING>, pipeline_metadata STRING"
)


def folder_name(path: Column) -> Column:
    """Feed files land in one folder per source."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    articles_path: str,
    sources_path: str,
    source_of: Callable[[Column], Column] = folder_name,
    rewrite: Rewrite = template_rewrite,
    keep_versions: int | None = None,
    **job,
) -> None:
    """Read the tables as of before the batch, run the job, write them as of after it.

    The version is the batch's number, so running a batch again gives the same tables.
    """
    spark = batch.sparkSession
    version = batch_id + 1
    named = number_arrivals(batch.withColumn("source_id", source_of(F.col("file_path"))), "source_id", "file_path")
    good, _, log = split_failed(named)
    fetches = log.select(source_of(F.col("file_path")).alias("source_id"), "ts", "ok", "error")
    result = fetch_and_process(
        good,
        read_latest(spark, sources_path, below=version),
        read_latest(spark, articles_path, ARTICLE_SCHEMA, below=version),
        fetches,
        F.col("fetched_at"),
        rewrite,
        **job,
    )
    write_next(result.articles, articles_path, version, keep_versions)
    write_next(result.sources, sources_path, version, keep_versions)


def start_ingest(entries: DataFrame, articles_path: str, sources_path: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Run the job per micro-batch of ``read_feed_files(..., stream=True)``; without ``every`` once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        entries.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, articles_path, sources_path, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
