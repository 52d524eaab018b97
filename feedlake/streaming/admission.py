"""Rolling per-key admission over a stream, one answer for every request.

Every micro-batch is answered by the batch operator, range-partitioned by key and time, so a busy key runs over many
tasks. What earlier batches leave behind are the last admits of each key, at most ``limit``; they enter as
requests of their own, before all others, and are admitted again because they were. They are kept in a bucketed table,
of which a batch reads and writes the buckets of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.functions.timestamps import micros
from feedlake.operators.throttle import throttle
from feedlake.session import materialize
from feedlake.sources.buckets import BucketTable

MARKS = "one INT, newest BIGINT"


def _tables(path: str, buckets: int) -> tuple[BucketTable, BucketTable]:
    return BucketTable(f"{path}/state", "key", "key STRING, recent ARRAY<BIGINT>", buckets), BucketTable(f"{path}/marks", "one", MARKS, 1)


def admit_batch(
    requests: DataFrame, path: str, version: int, key: str = "key", ts: str = "ts", tie: str = "event_id",
    limit: int = 60, window_s: int = 60, buckets: int = 64,
) -> None:
    """Answer a batch and store ``tie``, ``key``, ``admitted``, ``late`` as answers of ``version``.

    A request older than the newest one of earlier batches by more than a window is late: not admitted, flagged,
    and without effect. One that comes after younger requests of its key but is not late counts as
    made at the time of the last admitted of them, since answers are not taken back. Requests without a
    time are not admitted. A batch that runs again gives the same answers and the same state.
    """
    spark, window = requests.sparkSession, window_s * 1_000_000
    state, marks = _tables(path, buckets)
    mark = marks.read(spark, version).select(F.max("newest")).first()[0]
    late = F.lit(False) if mark is None else F.coalesce(F.col("at") < F.lit(mark - window), F.lit(False))
    rows = materialize(requests.select(
        F.col(tie).alias("tie"), F.col(key).cast("string").alias("key"), micros(ts).alias("at")).withColumn("late", late))
    known = materialize(state.lookup(rows.where("NOT late").select("key").distinct(), version))
    last = known.select("key", F.array_max("recent").alias("last"))
    live = rows.where("NOT late").join(last, "key", "left").select("tie", "key", F.greatest("at", F.when(F.col("at").isNotNull(), F.col("last"))).alias("at"))
    seeds = known.select(F.lit(None).cast(rows.schema["tie"].dataType).alias("tie"), "key", F.explode("recent").alias("at"))
    asked = materialize(live.unionByName(seeds).withColumn("ts", F.timestamp_micros("at")))
    # Seeds have no tie, which sorts first: at equal times they stay before the requests.
    answered = materialize(throttle(asked, "key", "ts", "tie", limit, window_s))
    answers = answered.where(F.col("tie").isNotNull()).withColumn("late", F.lit(False))
    rejected = rows.where("late").select("tie", "key", F.lit(False).alias("admitted"), "late")
    answers.unionByName(rejected).withColumnRenamed("tie", tie).write.mode("overwrite").parquet(f"{path}/answers/batch={version}")

    admits = answered.where("admitted AND tie IS NOT NULL").join(live, ["tie", "key"]).select("key", "at").unionByName(seeds.select("key", "at"))
    newest = W.partitionBy("key").orderBy(F.desc("at"))
    kept = admits.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit)
    recent = kept.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("recent"))
    ends = F.element_at("recent", -1)
    state.upsert(recent.withColumn("recent", F.filter("recent", lambda t: t > ends - window)), version)
    seen = rows.select(F.lit(1).alias("one"), "at").unionByName(spark.createDataFrame([(1, mark)], "one INT, at BIGINT"))
    marks.upsert(seen.groupBy("one").agg(F.max("at").alias("newest")), version)


def start_admission(requests: DataFrame, path: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Answer every micro-batch of a stream; without ``every`` once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def put(batch: DataFrame, number: int) -> None:
        admit_batch(batch, path, number + 1, **options)

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/answers").parquet(f"{path}/answers/batch=*").drop("batch")
