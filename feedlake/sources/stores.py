"""Article stores and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.functions.timestamps import parse_iso

ARTICLE_FIELDS = (
    "id STRING, source_id STRING, title STRING, content STRING, original_url STRING, published_at STRING, "
    "rewritten_content STRING, rewrite_status STRING, published_outputs ARRAY<STRING>"
)
SOURCE_FIELDS = (
    "id STRING, name STRING, url STRING, enabled BOOLEAN, last_fetched_at STRING, priority INT, weight DOUBLE, "
    "reliability_score DOUBLE, fetch_count BIGINT, success_count BIGINT, failure_count BIGINT, last_error STRING"
)
USER_FIELDS = "id STRING, username STRING, role STRING, created_at STRING"
SESSION_FIELDS = "token STRING, user_id STRING, expires_at STRING, created_at STRING"

STORE_TABLES = {"feed_sources": SOURCE_FIELDS, "articles": ARTICLE_FIELDS, "users": USER_FIELDS, "sessions": SESSION_FIELDS}
TIME_COLUMNS = ("published_at", "last_fetched_at", "created_at", "expires_at")

# What a record without the field means.
DEFAULTS = {
    "feed_sources": {
        "enabled": True, "priority": 1, "weight": 1.0, "reliability_score": 1.0,
        "fetch_count": 0, "success_count": 0, "failure_count": 0,
    },
    "articles": {"rewrite_status": "pending"},
    "users": {"role": "viewer"},
    "sessions": {},
}


def read_json_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a JSON store: a document (or many) of id -> record maps.

    A document that is not readable, or lacks the table, gives no rows.
    """
    fields = STORE_TABLES[table]
    schema = f"{table} MAP<STRING, STRUCT<{_as_struct(fields)}>>"
    store = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    rows = store.select(F.explode(F.map_values(table)).alias("r")).select("r.*")
    rows = rows.fillna(DEFAULTS[table]) if DEFAULTS[table] else rows
    times = {c: parse_iso(c) for c in TIME_COLUMNS if c in rows.columns}
    return rows.withColumns(times)


def _as_struct(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(",")))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


EVENT_SCHEMA = (
    "timestamp STRING, event_type STRING, severity STRING, module STRING, message STRING, details MAP<STRING, STRING>"
)


def read_event_log(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Events of a JSON Lines log, with ``ts`` parsed from the text stamp."""
    reader = (spark.readStream if stream else spark.read).schema(EVENT_SCHEMA).options(**options)
    return reader.json(path).withColumn("ts", parse_iso("timestamp"))
