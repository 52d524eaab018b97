"""Feed documents and their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake.functions.ids import article_id
from feedlake.functions.text import text_or_empty
from feedlake.session import materialize, release

# A link is the element's text (RSS) or its address attribute (Atom, where there may be several).
LINK = "ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>"
ENTRY_SCHEMA = f"title STRING, link {LINK}, description STRING, summary STRING, _corrupt_record STRING"
CHANNEL_SCHEMA = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING>>>"


def _address(links: str) -> Column:
    """The first link text, else the address of the link to the entry itself, else of any link, else empty."""
    texts = F.filter(F.transform(links, lambda l: F.trim(l["_VALUE"])), lambda t: t != "")
    own = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    first = lambda found: F.get(F.filter(F.transform(found, lambda l: l["_href"]), lambda h: h != ""), F.lit(0))
    return F.coalesce(F.get(texts, F.lit(0)), first(own), first(F.col(links)), F.lit(""))


def read_feed_files(spark: SparkSession, path: str, stream: bool = False, row_tag: str = "item", **options) -> DataFrame:
    """One row per ``<item>`` (or ``<entry>``) of the feed files below ``path``.

    Broken documents do not stop the read: what could not be parsed arrives in
    ``_corrupt_record``, with the file it came from.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").options(**options)
    rows = reader.schema(ENTRY_SCHEMA).load(path)
    return rows.select(
        text_or_empty("title").alias("title"),
        _address("link").alias("link"),
        text_or_empty("description").alias("description"),
        text_or_empty("summary").alias("summary"),
        F.col("_corrupt_record"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )


def explode_feed_xml(df: DataFrame, xml_col: str, *keep: str) -> DataFrame:
    """Entries of feed documents held in a column; ``pos`` is the position in the feed."""
    parsed = df.select(*keep, F.from_xml(F.col(xml_col), CHANNEL_SCHEMA).alias("doc"))
    entry = parsed.select(*keep, F.posexplode("doc.channel.item").alias("pos", "entry"))
    return entry.select(
        *keep, "pos",
        text_or_empty("entry.title").alias("title"),
        text_or_empty("entry.link").alias("link"),
        text_or_empty("entry.description").alias("description"),
    )


FRAGMENT = "title STRING, link STRING, description STRING, _corrupt_record STRING"
NO_ITEM, CUT_ITEM, MALFORMED_ITEM = "no item", "cut item", "malformed item"


def _without(text: Column, begin: str, end: str, keep) -> Column:
    """``text`` with each part from ``begin`` to ``end`` replaced by ``keep(part)``."""
    pieces = F.split(text, begin)

    def piece(p: Column, i: Column) -> Column:
        at = F.locate(end, p)
        inside = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        rest = F.when(at > 0, F.substring(p, at + len(end), F.length(p))).otherwise(F.lit(""))
        return F.when(i == 0, p).otherwise(F.concat(keep(inside), rest))

    return F.array_join(F.transform(pieces, piece), "")


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def read_feed_items(df: DataFrame, xml_col: str, *keep: str) -> DataFrame:
    """Items of feed documents held in a column, whatever shape the documents are in.

    A document is cut at its ``<item`` tags and every item is parsed by itself, so items may stand anywhere (in a
    channel, beside it as in RDF, or without one) and a broken item costs no other. What cannot be parsed is a row
    with ``error`` and its text in ``broken``: an item that does not end, one that is not well-formed, and a
    document without any item (``pos`` is null then). Character data sections and comments do not
    begin or end items. All in built-in expressions, without an exchange.
    """
    text = _without(F.col(xml_col), r"<!\[CDATA\[", "]]>", _escape)
    text = _without(text, "<!--", "-->", lambda c: F.lit(""))
    cut = df.select(*keep, F.col(xml_col).alias("_xml"), F.split(text, r"<item(?=[\s/>])").alias("_parts"))
    items = F.when(F.size("_parts") > 1, F.slice("_parts", F.lit(2), F.size("_parts") - 1))
    rows = cut.select(*keep, "_xml", F.posexplode_outer(items).alias("pos", "_part"))
    end, part = F.locate("</item>", F.col("_part")), F.col("_part")
    empty = F.regexp_extract(part, r"^[^<>]*/>", 0)
    whole = F.when(empty != "", F.concat(F.lit("<item"), empty)).when(
        end > 0, F.concat(F.lit("<item"), F.substring(part, F.lit(1), end + 6)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": "item"}
    read = rows.withColumn("_whole", whole).withColumn("_item", F.from_xml("_whole", FRAGMENT, options))
    error = (
        F.when(part.isNull(), F.lit(NO_ITEM))
        .when(F.col("_whole").isNull(), F.lit(CUT_ITEM))
        .when(F.col("_item").isNull() | F.col("_item._corrupt_record").isNotNull(), F.lit(MALFORMED_ITEM))
    )
    read = read.withColumn("error", error)
    good = F.col("error").isNull()
    broken = F.when(part.isNull(), F.col("_xml")).otherwise(F.coalesce("_whole", F.concat(F.lit("<item"), part)))
    return read.select(
        *keep, "pos",
        *(F.when(good, text_or_empty(f"_item.{c}")).alias(c) for c in ("title", "link", "description")),
        "error", F.when(~good, broken).alias("broken"),
    )


def split_failed(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readable entries, broken fragments, and one fetch-log row per file.

    Entries that can be read are kept whatever else is in their file. A fetch counts as
    failed when nothing could be read; the log names the error in either case. Takes
    entries that have been written once (``number_arrivals``): Spark does not answer from
    the raw files what touches nothing but the corrupt records.
    """
    log = entries.groupBy("file_path").agg(
        F.max(F.col("_corrupt_record").isNull()).alias("ok"),
        F.max("fetched_at").alias("ts"),
        F.max(F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed feed document"))).alias("error"),
    )
    broken = entries.where(F.col("_corrupt_record").isNotNull()).select("file_path", "_corrupt_record", "fetched_at")
    good = entries.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, broken, log


def number_arrivals(entries: DataFrame, *order: str) -> DataFrame:
    """Adds ``arrival``: unique, increasing with ``order`` and, inside it, with the read order.

    Numbers follow a range-partitioned sort, so no task sees more than its range; the
    numbered entries are written once because reading them again must not renumber them.
    The entries are written before they are sorted too: finding the ranges reads them an extra
    time, and feed files are parsed once only.
    """
    marked = materialize(entries.withColumn("_read", F.monotonically_increasing_id()))
    placed = marked.repartitionByRange(*order, "_read").sortWithinPartitions(*order, "_read")
    numbered = materialize(placed.withColumn("arrival", F.monotonically_increasing_id()).drop("_read"))
    release(marked)
    return numbered


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def to_raw_items(
    entries: DataFrame, sources: DataFrame, fetched_at: Column, null_url_policy: str = "reference"
) -> DataFrame:
    """Entries of enabled sources with id, source rank and ingest time.

    ``published_at`` is the time of the fetch, not the entry's own date. The rank columns
    are written first, so Spark knows their real size: it broadcasts them while they are
    below its limit, and no text is shuffled; beyond it AQE splits a source that holds a
    large share of the entries.
    """
    content = F.coalesce(F.nullif("description", F.lit("")), F.nullif("summary", F.lit("")), F.lit(""))
    url = text_or_empty("link")
    title = text_or_empty("title")
    ranks = enabled_sources(sources).select(
        F.col("id").alias("source_id"),
        F.col("name").alias("source_name"),
        F.coalesce("priority", F.lit(1)).alias("source_priority"),
        F.coalesce("weight", F.lit(1.0)).alias("source_weight"),
        F.coalesce("reliability_score", F.lit(1.0)).alias("source_reliability_score"),
    )
    items = entries.select(
        "arrival",
        "source_id",
        article_id(url, title, null_url_policy).alias("id"),
        title.alias("title"),
        content.alias("content"),
        url.alias("url"),
        fetched_at.alias("published_at"),
    )
    return items.join(materialize(ranks), "source_id")
