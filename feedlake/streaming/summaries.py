"""Summaries per key that grow micro-batch by micro-batch, with late rows counted.

A summary is a table of sums and of newest rows, so batches can be added in any order. A row is late if
its time lies more than the allowed lateness before the newest time of the batches before its own; it is
not added, only counted for its key. The state is a bucketed table: a batch writes the buckets
of its own keys, and one that runs again gives the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators.monitoring import job_run_report
from feedlake.operators.sources import apply_fetches
from feedlake.session import materialize
from feedlake.sources.buckets import BucketTable

LATE = "late_rows"
MARKS = "one INT, newest TIMESTAMP"


@dataclass(frozen=True)
class Summary:
    """What is kept per ``key``: ``sums`` are added, of ``newest`` (structs or times) the greatest stays.

    Both map a state column to its SQL type and the value of a row; ``ts`` is the row's time.
    """

    key: str
    ts: str
    sums: dict[str, Column]
    newest: dict[str, tuple[str, Column]]

    def state(self, path: str, buckets: int = 64) -> BucketTable:
        counts = [f"{c} BIGINT" for c in (*self.sums, LATE)]
        latest = [f"{c} {kind}" for c, (kind, _) in self.newest.items()]
        return BucketTable(f"{path}/state", self.key, ", ".join([f"{self.key} STRING", *counts, *latest]), buckets)

    def add(self, rows: DataFrame, path: str, version: int, late_s: int = 3600, buckets: int = 64) -> set[int]:
        """Add a batch to the state below ``path``; the buckets written.

        A key's rows are summed up in the tasks that read them, so a key of any size is one row per task.
        """
        spark = rows.sparkSession
        table, marks = self.state(path, buckets), BucketTable(f"{path}/marks", "one", MARKS, 1)
        mark = marks.read(spark, version).select(F.max("newest")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(self.ts) < F.lit(mark) - F.make_dt_interval(secs=F.lit(late_s)), F.lit(False))
        flagged = rows.withColumn(LATE, late)
        partial = materialize(flagged.groupBy(self.key).agg(
            *(F.coalesce(F.sum(F.when(~F.col(LATE), value)), F.lit(0)).cast("long").alias(c) for c, value in self.sums.items()),
            F.count_if(LATE).alias(LATE),
            *(F.max(F.when(~F.col(LATE), value)).cast(kind).alias(c) for c, (kind, value) in self.newest.items()),
            F.max(F.col(self.ts).cast("timestamp")).alias("_newest"),
        ))
        both = table.lookup(partial.select(self.key), version).unionByName(partial.drop("_newest"))
        merged = both.groupBy(self.key).agg(
            *(F.sum(c).alias(c) for c in (*self.sums, LATE)), *(F.max(c).alias(c) for c in self.newest))
        written = table.upsert(merged, version)
        newest = partial.select(F.lit(1).alias("one"), "_newest").unionByName(
            spark.createDataFrame([(1, mark)], "one INT, _newest TIMESTAMP"))
        marks.upsert(newest.groupBy("one").agg(F.max("_newest").alias("newest")), version)
        return written

    def start(self, rows: DataFrame, path: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
        """Add every micro-batch of a stream; without ``every`` once over what is there."""
        trigger = {"processingTime": every} if every else {"availableNow": True}

        def put(batch: DataFrame, number: int) -> None:
            self.add(batch, path, number + 1, **options)

        return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fetch_summary(tie: str = "event_id", tie_type: str = "BIGINT") -> Summary:
    """Of a fetch log (source_id, ts, ok, error): what source statistics need."""
    kind = f"STRUCT<ts: TIMESTAMP, tie: {tie_type}, ok: BOOLEAN, error: STRING>"
    return Summary(
        "source_id", "ts",
        {"runs": F.lit(1), "good": F.col("ok").cast("int")},
        {"last_good": ("TIMESTAMP", F.when(F.col("ok"), F.col("ts"))), "last": (kind, F.struct("ts", tie, "ok", "error"))},
    )


def run_summary(tie: str = "event_id", tie_type: str = "BIGINT") -> Summary:
    """Of job runs (name, interval_s, start, end, ok, error): what the summary of jobs needs."""
    kind = f"STRUCT<end: TIMESTAMP, tie: {tie_type}, ok: BOOLEAN, error: STRING, start: TIMESTAMP, interval_s: DOUBLE>"
    return Summary(
        "name", "end",
        {"run_count": F.lit(1), "success_count": F.col("ok").cast("int"), "failure_count": (~F.col("ok")).cast("int")},
        {"last": (kind, F.struct("end", tie, "ok", "error", "start", "interval_s"))},
    )


def source_stats_of(state: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` after all fetches in the state of ``fetch_summary``, and the late ones of each."""
    log = state.select(
        F.col("source_id").alias("id"), F.nullif("runs", F.lit(0)).alias("_runs"), F.col("good").alias("_good"),
        F.col("last_good").alias("_last_good"), F.col("last").alias("_last"))
    late = state.select(F.col("source_id").alias("id"), LATE)
    counted = apply_fetches(sources, log).join(late, "id", "left")
    return counted.withColumn(LATE, F.coalesce(LATE, F.lit(0)))


def job_runs_of(state: DataFrame) -> DataFrame:
    """The job summary from the state of ``run_summary``, and the late runs of each job.

    A job with late runs only has no state of its own yet and gives no row.
    """
    return job_run_report(state.where("run_count > 0"), LATE)
