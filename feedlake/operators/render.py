"""Outbound forms of articles: JSON items, RSS items, channel messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions.text import text_or_empty
from feedlake.functions.timestamps import in_utc, is_aware, iso_text, rfc822, utc_wall

# Channel names in publishing order.
CHANNELS = ["eitaa", "pwa", "rss"]


def _url(df: DataFrame) -> Column:
    names = [c for c in ("original_url", "url") if c in df.columns]
    filled = [F.nullif(F.col(c), F.lit("")) for c in names]
    return F.coalesce(*filled, F.lit(""))


def _content(df: DataFrame) -> Column:
    """Rewritten text wins even when it is empty; only null falls back."""
    names = [c for c in ("rewritten_content", "content") if c in df.columns]
    return F.coalesce(*[F.col(c) for c in names], F.lit(""))


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _published(df: DataFrame) -> Column:
    """UTC as ISO text; instants carry the offset, times without a zone do not."""
    text = iso_text(utc_wall(df, "published_at"))
    return F.concat(text, F.lit("+00:00")) if is_aware(df, "published_at") else text


def feed_items(df: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the ten fields of a published item; a date given as text that does not parse is null."""
    no_outputs = F.array().cast("array<string>")
    url = _url(df)
    return df.select(
        *keep,
        text_or_empty("id").alias("id"),
        _or(df, "source_id", F.lit("")).alias("source_id"),
        _or(df, "title", F.lit("")).alias("title"),
        _content(df).alias("content"),
        url.alias("original_url"),
        url.alias("url"),
        _published(df).alias("published_at"),
        _or(df, "rewrite_status", F.lit("pending")).alias("rewrite_status"),
        F.coalesce(_or(df, "published_outputs", no_outputs), no_outputs).alias("published_outputs"),
        _or(df, "pipeline_metadata", F.create_map().cast("map<string,string>")).alias("pipeline_metadata"),
    )


def json_items(df: DataFrame, *keep: str) -> DataFrame:
    """One JSON object per article: columns ``keep``, ``id``, ``item``."""
    items = feed_items(df, *keep)
    fields = [c for c in items.columns if c not in keep]
    return items.select(*keep, "id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))


def rss_fields(df: DataFrame, now: Column | None = None, *keep: str) -> DataFrame:
    """``title``, ``link``, ``guid``, ``description``, ``pubDate``; without a date that parses the item is dated ``now``."""
    stamp = utc_wall(df, "published_at")
    now = in_utc(F.current_timestamp() if now is None else now)
    url = _url(df)
    return df.select(
        *keep,
        text_or_empty("title").alias("title"),
        url.alias("link"),
        F.coalesce(F.nullif("id", F.lit("")), url).alias("guid"),
        _content(df).alias("description"),
        rfc822(F.coalesce(stamp, now)).alias("pubDate"),
    )


def rss_items(df: DataFrame, now: Column | None = None, *keep: str) -> DataFrame:
    """One ``<item>`` element per article: columns ``keep``, ``guid``, ``item``."""
    fields = rss_fields(df, now, *keep)
    guid = F.struct(F.lit("false").alias("_isPermaLink"), F.col("guid").alias("_VALUE")).alias("guid")
    element = F.to_xml(F.struct("title", "link", guid, "description", "pubDate"), {"rowTag": "item"})
    return fields.select(*keep, "guid", element.alias("item"))


def form_encode(c: Column) -> Column:
    """Form encoding; Spark keeps ``*`` and escapes ``~``, the format asked for is the reverse."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def channel_messages(df: DataFrame, chat_id: str, text_col: str = "rewritten_content") -> DataFrame:
    """Outbox: form-encoded body per article."""
    body = F.concat(
        F.lit("chat_id="), form_encode(F.lit(chat_id)), F.lit("&text="), form_encode(text_or_empty(text_col))
    )
    return df.select("id", body.alias("body"))


def publish_outputs(
    df: DataFrame, accepted: dict[str, Column], status_col: str = "rewrite_status"
) -> DataFrame:
    """Channels that took the article, in order; none unless it is completed."""
    names = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in accepted.items()]))
    done = F.coalesce(F.col(status_col) == "completed", F.lit(False))
    return df.withColumn("published_outputs", F.when(done, names).otherwise(F.array().cast("array<string>")))
