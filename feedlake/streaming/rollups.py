"""Rollups and first-copy filters over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators import monitoring as mon
from feedlake.operators.dedup import content_hash


def dedup_stream(df: DataFrame, text: str = "content", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """First copy of each text. State is one hash per text and lives for ``within``; a copy
    that comes later than that counts as new."""
    hashed = df.withColumn("content_sha", content_hash(text)).withWatermark(ts, within)
    return hashed.dropDuplicatesWithinWatermark(["content_sha"])


def event_rollup_stream(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per window: closed windows in append mode, open ones too in update mode.

    Rows later than ``late`` are dropped.
    """
    return mon.event_rollup(events.withWatermark("ts", late), every, by)


def start_updates(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store what each micro-batch changed, in a folder of its own that a rerun replaces."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = df.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last stored row of every key; open windows are among them."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def metric_counters_stream(samples: DataFrame) -> DataFrame:
    """Running sums, for update mode; state is one row per name."""
    return mon.metric_counters(samples)


def metric_gauges_stream(samples: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest values, for update mode; an older sample that arrives late changes nothing."""
    return mon.metric_gauges(samples, tie)


def timing_summary_stream(samples: DataFrame, tie: str | None = None) -> DataFrame:
    return mon.timing_summary(samples, tie)


def error_counts_stream(errors: DataFrame, tie: str | None = None) -> DataFrame:
    """Errors and last error per component, for update mode."""
    newest = F.struct("ts", tie) if tie else F.struct("ts")
    return errors.groupBy("component").agg(
        F.count("*").alias("errors_total"),
        F.max_by(F.struct("type", "message", F.col("ts").alias("timestamp")), newest).alias("last_error"),
    )
