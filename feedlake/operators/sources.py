"""Fetch statistics of feed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def update_source_stats(sources: DataFrame, fetch_log: DataFrame, tie: str | None = None) -> DataFrame:
    """Sources after the fetches of ``fetch_log``.

    Merging ranks with the scores from before; this result is for the next run. Sources
    without a fetch, disabled ones included, stay as they are.
    """
    newest = F.struct("ts", tie) if tie else F.struct("ts")
    log = fetch_log.groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("_runs"),
        F.count_if("ok").alias("_good"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("_last_good"),
        F.max_by(F.struct("ok", "error"), newest).alias("_last"),
    )
    return apply_fetches(sources, log)


def apply_fetches(sources: DataFrame, log: DataFrame) -> DataFrame:
    """``sources`` after the fetches that ``log`` sums up: id, _runs, _good, _last_good, _last (ok, error)."""
    fetched = F.col("_runs").isNotNull() & F.col("enabled")
    runs = F.col("fetch_count") + F.col("_runs")
    good = F.col("success_count") + F.col("_good")
    changes = {
        "fetch_count": runs,
        "success_count": good,
        "failure_count": F.col("failure_count") + F.col("_runs") - F.col("_good"),
        "reliability_score": good / runs,
        "last_fetched_at": F.coalesce("_last_good", "last_fetched_at"),
        "last_error": F.when(~F.col("_last.ok"), F.col("_last.error")),
    }
    return sources.join(log, "id", "left").select(
        *[F.when(fetched, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in sources.columns]
    )
