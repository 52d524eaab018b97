"""The ingest job: fetched entries in, articles, source statistics and outbox out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from feedlake.functions.text import prompt
from feedlake.operators.dedup import group_duplicates
from feedlake.operators.enrich import ProviderFactory, rewrite_with_fallback
from feedlake.operators.merge import clean_items, merge_combine, merge_pieces, winners
from feedlake.operators.render import CHANNELS, publish_outputs
from feedlake.operators.sources import update_source_stats
from feedlake.operators.tables import skip_completed, upsert_partial
from feedlake.plans.stages import Stage, process_articles
from feedlake.session import materialize
from feedlake.sources.feeds import to_raw_items

Rewrite = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class JobResult:
    articles: DataFrame
    processed: DataFrame
    sources: DataFrame


def template_rewrite(df: DataFrame) -> DataFrame:
    """Offline rewrite: title and content by the prompt template. Never fails."""
    text = prompt("title", "content")
    return df.withColumns({"rewritten_content": text, "rewrite_status": F.lit("completed"), "used_fallback": F.lit(False)})


def provider_rewrite(providers: Mapping[str, ProviderFactory], **retry) -> Rewrite:
    """Rewrite by external providers; where all fail the marked original counts as completed."""

    def rewrite(df: DataFrame) -> DataFrame:
        asked = df.withColumn("_prompt", prompt("title", "content"))
        answered = rewrite_with_fallback(asked, "_prompt", "content", providers, **retry)
        return answered.drop("_prompt").withColumn("rewrite_status", F.lit("completed"))

    return rewrite


def stages_rewrite(stages: Sequence[Stage]) -> Rewrite:
    """Rewrite by the content stages instead of a single call."""
    return lambda df: process_articles(df, stages).withColumn("used_fallback", F.lit(False))


def merged_items(raw: DataFrame, strategy: str = "priority", semantics: str = "greedy", **grouping) -> DataFrame:
    """Merged items with unique ids.

    Greedy grouping can leave two groups with the same id; the older group is stored first
    and the other then counts as already processed, so it is dropped. With strategy ``pieces``
    an article has the rows of ``merge_pieces``; ``combine`` needs texts that fit into a row.
    """
    groups = group_duplicates(raw, semantics, **grouping)
    best = winners(raw, groups).join(raw.select("arrival", "id"), "arrival")
    oldest = W.partitionBy("id").orderBy("group_id")
    chosen = best.withColumn("_n", F.row_number().over(oldest)).where("_n = 1")
    if strategy not in ("combine", "pieces"):
        return clean_items(raw.join(chosen.select("arrival"), "arrival"))
    kept = groups.join(chosen.select("group_id"), "group_id", "left_semi")
    return merge_pieces(raw, kept) if strategy == "pieces" else merge_combine(raw, kept)


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, structs as JSON where text is stored."""
    columns = []
    for f in schema:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and isinstance(df.schema[f.name].dataType, T.StructType):
            columns.append(F.to_json(f.name).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def fetch_and_process(
    entries: DataFrame,
    sources: DataFrame,
    articles: DataFrame,
    fetch_log: DataFrame,
    at: Column,
    rewrite: Rewrite = template_rewrite,
    channels: dict[str, Column] | None = None,
    **merge,
) -> JobResult:
    """One run: merge, skip what is done, rewrite, publish, store.

    Merging ranks sources with the statistics from before this run. ``rewrite`` fills
    rewritten_content and rewrite_status; an article it leaves failed is stored but not
    published.
    """
    accepted = {c: F.lit(True) for c in CHANNELS} if channels is None else channels
    raw = to_raw_items(entries, sources, at)
    todo = skip_completed(merged_items(raw, **merge), articles)
    pending = todo.select(
        "id", "source_id", "title", "content", F.col("url").alias("original_url"), "published_at",
        F.lit(None).cast("string").alias("rewritten_content"), F.lit("pending").alias("rewrite_status"),
    )
    # Written once: a provider must not be asked again for the same article.
    processed = materialize(publish_outputs(rewrite(pending), accepted))
    stored = upsert_partial(articles, _shaped(processed, articles.schema), "id")
    return JobResult(stored, processed, update_source_stats(sources, fetch_log))
