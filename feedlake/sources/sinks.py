"""Versioned tables, event logs and published feeds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from feedlake.operators.monitoring import event_log
from feedlake.operators.render import json_items, rss_items
from feedlake.session import materialize

#: Write option for new folders of very many files: tasks move their files into place, instead of the driver one by one.
#: Such a folder is read only after its write has ended, so nobody sees half of it.
COMMIT_IN_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    base, fs = _filesystem(spark, path)
    return [e.getPath().getName() for e in fs.listStatus(base)] if fs.exists(base) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    target, fs = _filesystem(spark, path)
    fs.delete(target, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions below ``path``, ascending."""
    base, fs = _filesystem(spark, path)
    if not fs.exists(base):
        return []
    found = []
    for entry in fs.listStatus(base):
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def read_latest(spark: SparkSession, path: str, schema=None, below: int | None = None) -> DataFrame:
    """The newest version of a table, or the newest before ``below``; empty before the first."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/v={known[-1]}")


def write_next(df: DataFrame, path: str, version: int | None = None, keep: int | None = None) -> int:
    """Write a new version of a table, and drop all but the newest ``keep`` before it.

    Readers see a version once its commit file is there. Writing the same version again
    replaces it, so a rerun batch leaves one result.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    if version is None:
        version = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    if keep is not None:
        for old in [v for v in known if v < version][:-keep]:
            delete_folder(spark, f"{path}/v={old}")
    return version


def write_event_log(events: DataFrame, path: str) -> None:
    event_log(events).write.mode("append").json(path)


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` articles, for callers that want a bounded feed."""
    return df.orderBy(F.col("published_at").desc(), F.col("id")).limit(n)


def _write_feed(items: DataFrame, path: str, head: Mapping[str, str]) -> int:
    """Items as text part files, then a manifest that names their folder and number.

    Tasks write the parts and nothing passes through the driver. Readers go by the newest
    manifest, so they see the old feed or the new one as a whole.
    """
    spark = items.sparkSession
    counted = Observation()
    folder = f"items-{uuid.uuid4().hex}"
    items.select("item").observe(counted, F.count("item").alias("n")).write.text(f"{path}/{folder}")
    manifest = {**head, "count": int(counted.get["n"]), "items": folder}
    schema = ", ".join(f"{k} {'BIGINT' if k == 'count' else 'STRING'}" for k in manifest)
    write_next(spark.createDataFrame([tuple(manifest.values())], schema), f"{path}/manifest")
    return manifest["count"]


def write_json_feed(df: DataFrame, path: str, generated_at: str) -> int:
    """All articles as JSON items, one on a line, with a manifest (version, generated_at, count)."""
    return _write_feed(json_items(df), path, {"version": "1.0", "generated_at": generated_at})


def write_rss_feed(
    df: DataFrame, path: str, title: str, link: str, description: str, built_at: str, now: Column | None = None
) -> int:
    """All articles as ``<item>`` elements, with a manifest that holds the channel's own fields."""
    head = {"title": title, "link": link, "description": description, "lastBuildDate": built_at}
    return _write_feed(rss_items(df, now), path, head)


def read_feed_manifest(spark: SparkSession, path: str) -> dict:
    return read_latest(spark, f"{path}/manifest").first().asDict()


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of the newest feed, as JSON text in ``item``."""
    return spark.read.text(f"{path}/{read_feed_manifest(spark, path)['items']}").withColumnRenamed("value", "item")


def read_rss_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of the newest feed: title, link, guid, description, pubDate."""
    parts = f"{path}/{read_feed_manifest(spark, path)['items']}"
    end = "</item>"
    schema = "title STRING, link STRING, guid STRUCT<_VALUE: STRING, _isPermaLink: STRING>, description STRING, pubDate STRING"
    # Items run over several lines; in texts the end tag is escaped, so it separates items.
    rows = spark.read.option("lineSep", f"{end}\n").text(parts)
    item = F.from_xml(F.concat("value", F.lit(end)), schema, {"rowTag": "item", "ignoreSurroundingSpaces": "false"})
    read = rows.select(item.alias("i")).select("i.*")
    texts = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (
        ("title", "title"), ("link", "link"), ("guid._VALUE", "guid"), ("description", "description"))]
    return read.select(*texts, "pubDate")


def fan_out(df: DataFrame, targets: Mapping[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Hand the same articles to every target; one target's failure does not stop the others.

    The articles are stored once in the shared folder, so every target reads the same rows.
    Returns one row per target: ``target``, ``ok``, ``error``.
    """
    rows = []
    stored = materialize(df)
    for name, write in targets.items():
        try:
            write(stored)
            rows.append((name, True, None))
        except Exception as error:
            rows.append((name, False, f"{type(error).__name__}: {error}"))
    return df.sparkSession.createDataFrame(rows, "target STRING, ok BOOLEAN, error STRING")
