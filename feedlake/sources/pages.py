"""Pages: feeds whose files are whole RSS or JSON documents, and a stored index for pages of a table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake.operators.render import json_items, rss_items
from feedlake.operators.tables import PAGE_COLUMNS
from feedlake.session import materialize
from feedlake.sources.sinks import COMMIT_IN_TASKS, delete_folder, folder_names, read_feed_manifest, read_latest, versions, write_next

PAGE_ITEMS = 500
MANIFEST = "count BIGINT, pages BIGINT, items STRING"
ROW_BITS = 33


def number_rows(df: DataFrame, name: str, *order: Column) -> tuple[DataFrame, int]:
    """``df``, stored, with its position by ``order`` from 0 in column ``name``; and its number of rows.

    Rows are sorted in ranges; the driver adds up one count per range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn(name, F.monotonically_increasing_id()))
    part, row = F.shiftright(name, ROW_BITS), F.col(name).bitwiseAND((1 << ROW_BITS) - 1)
    offsets, at = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], at))
        at += r["count"]
    base = placed.sparkSession.createDataFrame(offsets, "_part BIGINT, _base BIGINT")
    joined = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return joined.withColumn(name, F.col("_base") + row).drop("_part", "_base"), at


@dataclass(frozen=True)
class PageIndex:
    """Positions of a table's rows by a unique column, stored once and used by every page.

    The index holds (key, position) in order, so a page is a range of positions: the filter reaches the scan and all other
    row groups are skipped by their bounds, whatever the page. It must be built anew when keys come or go.
    """

    path: str
    order_by: str

    def build(self, df: DataFrame) -> int:
        """Sort the keys of ``df`` and store them; the number of rows."""
        placed, total = number_rows(df.select(self.order_by), "position", F.col(self.order_by))
        version = write_next(placed, f"{self.path}/keys")
        write_next(df.sparkSession.createDataFrame([(total, version)], "total BIGINT, version BIGINT"), f"{self.path}/totals")
        return total

    def keys(self, spark: SparkSession, start: int, limit: int) -> tuple[DataFrame, int]:
        """(key, position) of at most ``limit`` rows from ``start`` on, and the number of rows."""
        last = read_latest(spark, f"{self.path}/totals").first()
        held = spark.read.parquet(f"{self.path}/keys/v={last['version']}")
        return held.where((F.col("position") >= start) & (F.col("position") < start + limit)), last["total"]

    def page(self, df: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
        """One page of ``df`` in order, with the total row count, like ``paginate`` but without sorting the keys."""
        if page < 1 or limit < 1:
            raise ValueError("page and limit must be at least 1")
        keys, total = self.keys(df.sparkSession, (page - 1) * limit, limit)
        columns = [c for c in PAGE_COLUMNS if c in df.columns]
        found = df.join(keys.select(self.order_by), self.order_by).select(*columns)
        return found.orderBy(self.order_by).withColumn("total", F.lit(total).cast("long"))


def _write_pages(items: DataFrame, count: int, path: str, page_items: int, document, keep: int) -> int:
    """One file per page of ``items`` (_place, item), then the manifest; folders no manifest names are removed.

    ``document(page, items)`` makes the text of a page out of its number and the array of its items. A page is a row, so
    no task holds more than ``page_items`` articles of it.
    """
    spark, folder = items.sparkSession, f"items-{uuid.uuid4().hex}"
    page = F.floor(F.col("_place") / page_items).cast("int").alias("page")
    listed = items.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("_place", "item"))).alias("rows"))
    text = document(F.col("page"), F.transform("rows", lambda r: r["item"]))
    # A feed without articles still has one page.
    empty = spark.createDataFrame([(0, [])], listed.schema) if not count else None
    listed = listed.unionByName(empty) if empty is not None else listed
    listed.select("page", text.alias("value")).write.option("lineSep", "\n").option(*COMMIT_IN_TASKS).partitionBy("page").text(f"{path}/{folder}")
    n_pages = max(1, -(-count // page_items))
    write_next(spark.createDataFrame([(count, n_pages, folder)], MANIFEST), f"{path}/manifest")
    kept = versions(spark, f"{path}/manifest")[-keep:]
    named = {read_latest(spark, f"{path}/manifest", below=v + 1).first()["items"] for v in kept}
    for name in folder_names(spark, path):
        if name.startswith("items-") and name not in named:
            delete_folder(spark, f"{path}/{name}")
    return n_pages


def _neighbours(page: Column, last: int, base: str) -> tuple[Column, Column]:
    """Addresses of the pages before and after, null where there is none."""
    address = lambda p: F.concat(F.lit(f"{base}/page="), p.cast("string"))
    return F.when(page > 0, address(page - 1)), F.when(page < last, address(page + 1))


def _newest_first(df: DataFrame) -> tuple[DataFrame, int]:
    return number_rows(df, "_place", F.col("published_at").desc_nulls_last(), F.col("id"))


def write_rss_pages(
    df: DataFrame, path: str, base: str, title: str, link: str, description: str, built_at: str,
    page_items: int = PAGE_ITEMS, now: Column | None = None, keep: int = 2,
) -> int:
    """All articles, newest first, as RSS documents with ``next`` and ``previous`` links below ``base``; the number of pages.

    The folders of the newest ``keep`` feeds stay, so a reader that has begun can go on.
    """
    placed, count = _newest_first(df)
    last = max(0, -(-count // page_items) - 1)
    names = {"title": title, "link": link, "description": description, "lastBuildDate": built_at}
    head = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in names.items())

    def document(page: Column, items: Column) -> Column:
        before, after = _neighbours(page, last, escape(base))
        links = [
            F.coalesce(F.concat(F.lit(f'<atom:link rel="{rel}" href="'), to, F.lit('"/>')), F.lit(""))
            for rel, to in (("previous", before), ("next", after))
        ]
        start = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel>{head}'
        return F.concat(F.lit(start), *links, F.lit("\n"), F.array_join(items, "\n"), F.lit("\n</channel></rss>"))

    return _write_pages(rss_items(placed, now, "_place"), count, path, page_items, document, keep)


def write_json_pages(df: DataFrame, path: str, base: str, generated_at: str, page_items: int = PAGE_ITEMS, keep: int = 2) -> int:
    """All articles, newest first, as JSON documents (version, generated_at, count, page, previous, next, items)."""
    placed, count = _newest_first(df)
    last = max(0, -(-count // page_items) - 1)

    def document(page: Column, items: Column) -> Column:
        before, after = _neighbours(page, last, base)
        fields = F.struct(
            F.lit("1.0").alias("version"), F.lit(generated_at).alias("generated_at"), F.lit(count).cast("long").alias("count"),
            page.alias("page"), before.alias("previous"), after.alias("next"))
        head = F.to_json(fields, {"ignoreNullFields": "false"})
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"items":[\n'), F.array_join(items, ",\n"), F.lit("\n]}"))

    return _write_pages(json_items(placed, "_place"), count, path, page_items, document, keep)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the newest feed: ``page``, ``document``."""
    folder = f"{path}/{read_feed_manifest(spark, path)['items']}"
    files = spark.read.option("basePath", folder).schema("value STRING, page INT").text(f"{folder}/page=*", wholetext=True)
    return files.select("page", F.col("value").alias("document"))
