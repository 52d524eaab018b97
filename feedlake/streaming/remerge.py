"""The ingest job that merges every batch with the stored groups it touches.

Bucketed tables: ``keys`` (id or title to group), ``moved`` (groups joined to older ones), ``articles`` (one row per
group: its winner, rewritten and published, and the batch that did it), ``sources``, and ``runs`` (a row per batch with its
duration, numbered as in ``articles``). A batch reads and writes only the buckets of
its own keys, groups and sources. Versions are batch numbers, so a batch that runs again gives the same tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.incremental import best_of, follow, grow_groups, item_nodes, keys_of, ranked_candidates, with_contents
from feedlake.operators.merge import CLEAN_COLUMNS, RANKS
from feedlake.operators.render import CHANNELS, publish_outputs
from feedlake.operators.sources import update_source_stats
from feedlake.plans.jobs import Rewrite, template_rewrite
from feedlake.session import materialize
from feedlake.sources.buckets import BucketTable
from feedlake.sources.feeds import number_arrivals, split_failed, to_raw_items
from feedlake.streaming.ingest import folder_name

#: A batch numbers its entries from batch number times this.
BATCH_ROWS = 1 << 38

ARTICLES = (
    "group_id BIGINT, arrival BIGINT, priority_rank INT, weight_rank DOUBLE, reliability_rank DOUBLE, id STRING, source_id STRING, "
    "title STRING, content STRING, url STRING, published_at TIMESTAMP, rewritten_content STRING, rewrite_status STRING, "
    "published_outputs ARRAY<STRING>, batch BIGINT"
)
RUNS = "batch BIGINT, started TIMESTAMP, ended TIMESTAMP, seconds DOUBLE, n_items BIGINT, n_articles BIGINT"
SOURCES = (
    "id STRING, name STRING, url STRING, enabled BOOLEAN, last_fetched_at TIMESTAMP, priority INT, weight DOUBLE, "
    "reliability_score DOUBLE, fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING"
)


@dataclass(frozen=True)
class ArticleStore:
    """The tables below one folder."""

    path: str
    buckets: int = 256

    @property
    def keys(self) -> BucketTable:
        return BucketTable(f"{self.path}/keys", "key", "key STRING, label BIGINT", self.buckets)

    @property
    def moved(self) -> BucketTable:
        return BucketTable(f"{self.path}/moved", "label", "label BIGINT, into BIGINT", self.buckets)

    @property
    def articles(self) -> BucketTable:
        return BucketTable(f"{self.path}/articles", "group_id", ARTICLES, self.buckets)

    @property
    def sources(self) -> BucketTable:
        return BucketTable(f"{self.path}/sources", "id", SOURCES, self.buckets)

    @property
    def runs(self) -> BucketTable:
        return BucketTable(f"{self.path}/runs", "batch", RUNS, self.buckets)

    def tables(self) -> list[BucketTable]:
        return [self.keys, self.moved, self.articles, self.sources, self.runs]

    def current(self, spark: SparkSession) -> DataFrame:
        """One row per article id: where two groups have a winner with one id, the older group's."""
        oldest = W.partitionBy("id").orderBy("group_id")
        return self.articles.read(spark).withColumn("_n", F.row_number().over(oldest)).where("_n = 1").drop("_n")

    def drop_unused(self, spark: SparkSession, keep: int = 2) -> None:
        for table in self.tables():
            table.drop_unused(spark, keep)


def merge_items(
    store: ArticleStore,
    raw: DataFrame,
    version: int,
    rewrite: Rewrite = template_rewrite,
    channels: dict[str, Column] | None = None,
    semantics: str = "greedy",
) -> dict[str, set[int]]:
    """Merge the raw items of a batch into the stored groups; the buckets written, by table.

    ``arrival`` must be greater than in earlier batches. Groups are those of one run over all batches.
    A group whose winner is a new one is rewritten and published again; others keep what they have. Items
    without an id (an empty text counts as none) are grouped and never become an article.
    """
    spark, began = raw.sparkSession, dt.datetime.now(dt.UTC)
    raw = materialize(raw)
    nodes = materialize(item_nodes(raw))
    known = store.keys.lookup(materialize(keys_of(nodes)), version)
    if semantics == "transitive":
        known = follow(known, lambda labels: store.moved.lookup(labels, version))
    known = materialize(known)
    grown = grow_groups(nodes, known, semantics)
    groups, moved = materialize(grown.groups), materialize(grown.moved)
    changed = grown.keys.join(known.withColumnRenamed("label", "old"), "key", "left").where("old IS NULL OR old <> label").drop("old")
    written = {"keys": store.keys.upsert(changed, version)}
    # Only joined groups move, and greedy ones are never joined.
    written["moved"] = store.moved.upsert(moved, version) if semantics == "transitive" else set()

    # Winners of groups that were joined compete in the older group. All is decided without texts.
    named = raw.where("id IS NOT NULL AND id <> ''")
    candidates = ranked_candidates(named, groups)
    left = store.articles.lookup(moved.select(F.col("label").alias("group_id")), version)
    joined = left.join(moved.withColumnRenamed("label", "group_id"), "group_id").withColumn("group_id", F.col("into"))
    columns = candidates.columns
    candidates = materialize(candidates.unionByName(joined.select(*columns)))
    held = materialize(store.articles.lookup(candidates.select("group_id").distinct(), version).select(*columns))
    best = best_of(held, candidates)
    news = best.join(held.select("group_id", F.col("arrival").alias("was")), "group_id", "left").where("was IS NULL OR was <> arrival")
    news = materialize(news.drop("was"))
    # A new winner is an item of the batch or the winner of a group that was joined.
    texts = named.select("arrival", *CLEAN_COLUMNS).unionByName(left.select("arrival", *CLEAN_COLUMNS))
    pending = with_contents(news, texts).withColumnRenamed("url", "original_url").withColumns(
        {"rewritten_content": F.lit(None).cast("string"), "rewrite_status": F.lit("pending")})
    accepted = {c: F.lit(True) for c in CHANNELS} if channels is None else channels
    done = publish_outputs(rewrite(pending), accepted).withColumnRenamed("original_url", "url")
    gone = moved.select(F.col("label").alias("group_id"))
    written["articles"] = store.articles.upsert(done.withColumn("batch", F.lit(version)), version, gone, news)
    ended = dt.datetime.now(dt.UTC)
    row = (version, began, ended, (ended - began).total_seconds(), raw.count(), news.count())
    written["runs"] = store.runs.upsert(spark.createDataFrame([row], RUNS), version)
    return written


def dense_arrivals(entries: DataFrame, batch_id: int) -> DataFrame:
    """``arrival`` of numbered entries without gaps, from ``batch_id * BATCH_ROWS`` on."""
    part, row = F.shiftright("arrival", 33), F.col("arrival").bitwiseAND((1 << 33) - 1)
    # One row per task that numbered them.
    sizes = entries.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, at = [], batch_id * BATCH_ROWS
    for size in sizes:
        offsets.append((size["part"], at))
        at += size["count"]
    base = entries.sparkSession.createDataFrame(offsets, "_part BIGINT, _base BIGINT")
    placed = entries.withColumn("_part", part).join(F.broadcast(base), "_part")
    return placed.withColumn("arrival", F.col("_base") + row).drop("_part", "_base")


def remerge_batch(
    batch: DataFrame, batch_id: int, store: ArticleStore, source_of: Callable[[Column], Column] = folder_name, **job
) -> dict[str, set[int]]:
    """One batch of feed entries into the store; the buckets written, by table.

    Sources rank with their statistics from before the batch. Files that cannot be read count as failed fetches.
    """
    version = batch_id + 1
    named = number_arrivals(batch.withColumn("source_id", source_of(F.col("file_path"))), "source_id", "file_path")
    good, _, log = split_failed(named)
    fetches = materialize(log.select(source_of(F.col("file_path")).alias("source_id"), "ts", "ok", "error"))
    sources = materialize(store.sources.lookup(fetches.select(F.col("source_id").alias("id")).distinct(), version))
    raw = to_raw_items(dense_arrivals(good, batch_id), sources, F.col("fetched_at"))
    written = merge_items(store, raw, version, **job)
    written["sources"] = store.sources.upsert(update_source_stats(sources, fetches), version)
    return written


def start_remerge(entries: DataFrame, store: ArticleStore, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Run ``remerge_batch`` per micro-batch of ``read_feed_files(..., stream=True)``; without ``every`` once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def merge(df: DataFrame, n: int) -> None:
        remerge_batch(df, n, store, **options)

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()
