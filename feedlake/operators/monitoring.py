"""Rollups of metric samples, errors, events and job runs.

Every rollup aggregates before it shuffles, so a name that holds most of the rows costs
one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.functions.rounding import round_exact
from feedlake.functions.timestamps import micros, utc_wall


UNKNOWN_COMPONENT = "unknown"


def _newest(tie: str | None, ts: str = "ts") -> Column:
    """Order of samples; a struct, so rows without a time count as the oldest."""
    return F.struct(ts, tie) if tie else F.struct(ts)


def metric_counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.sum("value").alias("value"))


def metric_gauges(samples: DataFrame, tie: str | None = None) -> DataFrame:
    return samples.groupBy("name").agg(F.max_by("value", _newest(tie)).alias("value"))


def timing_summary(samples: DataFrame, tie: str | None = None) -> DataFrame:
    """Last, count, total, average and longest duration per operation, to four places."""
    return samples.groupBy("name").agg(*_timing_parts(tie)).select("name", *_timing_columns(), round_exact(F.col("longest"), 4).alias("max_duration_seconds"))


def _timing_parts(tie: str | None) -> list[Column]:
    return [
        F.max_by("value", _newest(tie)).alias("last"),
        F.count("value").alias("executions_total"),
        F.sum("value").cast("double").alias("total"),
        F.max("value").alias("longest"),
    ]


def _timing_columns() -> list[Column]:
    return [
        round_exact(F.col("last"), 4).alias("last_duration_seconds"),
        F.col("executions_total"),
        round_exact(F.col("total"), 4).alias("duration_seconds_total"),
        round_exact(F.col("total") / F.col("executions_total"), 4).alias("average_duration_seconds"),
    ]


def error_summary(errors: DataFrame, tie: str | None = None) -> DataFrame:
    """Error count and last error per component, and a row with ``is_total`` and no component.

    Errors without a component count for ``UNKNOWN_COMPONENT``.
    """
    named = errors.withColumn("component", F.coalesce("component", F.lit(UNKNOWN_COMPONENT)))
    return named.rollup("component").agg(
        (F.grouping("component") == 1).alias("is_total"),
        F.count("*").alias("errors_total"),
        F.max_by(F.struct("type", "message", F.col("ts").alias("timestamp")), _newest(tie)).alias("last_error"),
    )


def event_log(events: DataFrame) -> DataFrame:
    """Log lines: upper-case severity, second precision, details never null."""
    return events.select(
        F.date_format(utc_wall(events, "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "event_type",
        F.upper("severity").alias("severity"),
        "module",
        "message",
        F.coalesce("details", F.create_map().cast("map<string,string>")).alias("details"),
    )


def event_rollup(events: DataFrame, every: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return (
        events.groupBy(F.window("ts", every).alias("w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), *by, "n")
    )


def job_run_summary(runs: DataFrame, tie: str | None = None) -> DataFrame:
    """State of each job after its runs; the error is the last run's, so a success clears it."""
    last = F.max_by(
        F.struct("ok", "error", "start", "end", "interval_s"), _newest(tie, "end")
    )
    summary = runs.groupBy("name").agg(
        F.count("*").alias("run_count"),
        F.count_if("ok").alias("success_count"),
        F.count_if(~F.col("ok")).alias("failure_count"),
        last.alias("last"),
    )
    return job_run_report(summary)


def job_run_report(summary: DataFrame, *keep: str) -> DataFrame:
    """Job states from counts and the last run (ok, error, start, end, interval_s) of each job."""
    return summary.select(
        "name", *keep, "run_count", "success_count", "failure_count",
        F.when(F.col("last.ok"), F.lit("success")).otherwise(F.lit("failed")).alias("last_status"),
        F.when(~F.col("last.ok"), F.col("last.error")).alias("last_error"),
        F.col("last.start").alias("last_run_start"),
        F.col("last.end").alias("last_run_end"),
        ((micros("last.end") - micros("last.start")) / F.lit(1e6)).alias("last_duration"),
        (F.col("last.end") + F.make_dt_interval(secs=F.col("last.interval_s").cast("decimal(18,6)"))).alias("next_run"),
    )


def _metric_rows(samples: DataFrame, tie: str | None) -> DataFrame:
    """(name, value): the sum of every metric and the four parts of its timing."""
    parts = ["last_duration_seconds", "executions_total", "duration_seconds_total", "average_duration_seconds"]
    totals = samples.groupBy("name").agg(*_timing_parts(tie), F.sum("value").alias("sum"))
    timed = totals.select("name", "sum", *_timing_columns())
    values = [F.struct("name", F.col("sum").cast("double").alias("value"))]
    values += [F.struct(F.concat("name", F.lit(f"_{p}")).alias("name"), F.col(p).cast("double").alias("value")) for p in parts]
    return timed.select(F.explode(F.array(*values)).alias("m")).select("m.*")


def _error_name() -> Column:
    return F.when(F.col("is_total"), F.lit("total_errors")).otherwise(F.concat(F.lit("errors_"), "component", F.lit("_total")))


def dashboard_rows(samples: DataFrame, errors: DataFrame, tie: str | None = None) -> DataFrame:
    """The dashboard as a row per name: ``name``, ``value``, and ``last_error`` where it counts a component's errors.

    For any number of names: nothing is gathered.
    """
    failures = error_summary(errors, tie)
    failed = failures.select(
        _error_name().alias("name"), F.col("errors_total").cast("double").alias("value"),
        F.when(~F.col("is_total"), F.col("last_error")).alias("last_error"))
    return _metric_rows(samples, tie).withColumn("last_error", F.lit(None).cast(failed.schema["last_error"].dataType)).unionByName(failed)


def dashboard_summary(samples: DataFrame, errors: DataFrame, tie: str | None = None) -> DataFrame:
    """One record: status, all metrics by name, and the last error per component.

    Samples and errors are read once each; what is put together has a row per name and must fit
    into one, else use ``dashboard_rows``.
    """
    metrics = _metric_rows(samples, tie).agg(F.collect_list(F.struct("name", "value")).alias("metrics"))
    failures = error_summary(errors, tie)
    failed = failures.agg(
        F.collect_list(F.struct(_error_name().alias("name"), F.col("errors_total").cast("double").alias("value"))).alias("counts"),
        F.collect_list(F.when(~F.col("is_total"), F.struct("component", "last_error"))).alias("details"),
    )
    # Both sides are one row.
    return metrics.crossJoin(failed).select(
        F.lit("ok").alias("status"),
        F.map_from_entries(F.sort_array(F.concat("metrics", "counts"))).alias("metrics"),
        F.map_from_entries(F.sort_array("details")).alias("error_details"),
    )


def rolling_request_count(requests: DataFrame, key: str = "key", tie: str = "event_id", window_s: int = 60) -> DataFrame:
    """Earlier requests of the same key within the window, ties included.

    Time is cut into slices of one window. A row counts in its own slice and is context
    for the next one, so a busy key is spread over its slices.
    """
    size = window_s * 1_000_000
    base = requests.select(F.col(key).alias("key"), F.col(tie), micros("ts").alias("at"))
    own = F.floor(F.col("at") / F.lit(size)).cast("long")
    slices = base.withColumn("slice", F.explode(F.array(own, own + 1))).withColumn("mine", F.col("slice") == own)
    w = W.partitionBy("key", "slice").orderBy("at").rangeBetween(-size, W.currentRow)
    counted = slices.withColumn("n_prev", F.count("*").over(w) - 1)
    return counted.where("mine").select(tie, "key", "n_prev")
