"""One article per duplicate group, by source rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.functions.text import strip, text_or_empty
from feedlake.operators.dedup import group_duplicates
from feedlake.session import materialize

CLEAN_COLUMNS = ["id", "source_id", "title", "content", "url", "published_at"]
RANKS = ["priority_rank", "weight_rank", "reliability_rank"]


def rank_columns() -> list[Column]:
    """Ascending form of priority, weight and reliability, all descending."""
    return [
        (-F.coalesce(F.col("source_priority"), F.lit(1))).alias(RANKS[0]),
        (-F.coalesce(F.col("source_weight"), F.lit(1.0))).alias(RANKS[1]),
        (-F.coalesce(F.col("source_reliability_score"), F.lit(1.0))).alias(RANKS[2]),
    ]


def clean_items(df: DataFrame) -> DataFrame:
    return df.select(*CLEAN_COLUMNS)


def winners(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """The best-ranked item of each group: ``order``, ``group_id``. Ties: the earliest.

    Works on rank columns alone; the rank filter keeps one row per group and task
    before the shuffle.
    """
    ranked = items.select(order, *rank_columns()).join(groups, order)
    best = W.partitionBy("group_id").orderBy(*RANKS, order)
    return ranked.withColumn("place", F.row_number().over(best)).where("place = 1").select(order, "group_id")


def merge_priority(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """The winner of each group; texts move once, in the last join."""
    return clean_items(items.join(winners(items, groups, order).select(order), order))


def separator(source_name: Column) -> Column:
    return F.concat(F.lit("\n\n--- [Alternative Content from "), text_or_empty(source_name), F.lit("] ---\n"))


def _contributions(items: DataFrame, groups: DataFrame, order: str) -> DataFrame:
    """First item per group and trimmed content, without the content.

    Blank content counts as one more value here: it only matters when it belongs to the
    winner, which the assembly decides.
    """
    trimmed = strip(text_or_empty("content"))
    narrow = items.select(
        order,
        *rank_columns(),
        F.when(trimmed != "", F.unhex(F.sha2(trimmed, 256))).alias("content_key"),
    ).join(groups, order)
    first = W.partitionBy("group_id", "content_key").orderBy(*RANKS, order)
    return (
        narrow.withColumn("place", F.row_number().over(first))
        .where("place = 1")
        .select("group_id", order, *RANKS, F.col("content_key").isNull().alias("blank"))
    )


def _placed(items: DataFrame, groups: DataFrame, order: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Place of every member in its group's text, without texts: ``group_id``, ``lead`` (the winner's
    ``order``), the winner's ``fields``, ``position``, ``order``.

    The fields come by the one row per group and range, so no group is gathered for them.
    """
    kept = _contributions(items, groups, order)
    ranged = materialize(
        kept.repartitionByRange("group_id", *RANKS, order).withColumn("slot", F.spark_partition_id())
    )
    firsts = ranged.groupBy("group_id", "slot").agg(F.min(F.struct(*RANKS, order)).alias("first"))
    best = F.min("first").over(W.partitionBy("group_id"))
    leads = firsts.select("group_id", "slot", best.getField(order).alias("lead"))
    used = ranged.join(leads, ["group_id", "slot"]).withColumn("is_lead", F.col(order) == F.col("lead"))
    used = used.where(F.col("is_lead") | ~F.col("blank")).select("group_id", "lead", "slot", *RANKS, order)
    earlier = W.partitionBy("group_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    before = used.groupBy("group_id", "slot").agg(F.count("*").alias("n"), F.first("lead").alias("lead")).select(
        "group_id", "slot", "lead", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    if fields:
        before = before.join(items.select(F.col(order).alias("lead"), *fields), "lead")
    inside = W.partitionBy("group_id", "slot").orderBy(*RANKS, order)
    placed = used.drop("lead").withColumn("within", F.row_number().over(inside) - 1).join(before, ["group_id", "slot"])
    return placed.select("group_id", "lead", *fields, (F.col("before") + F.col("within")).alias("position"), order)


def _with_texts(placed: DataFrame, items: DataFrame, order: str) -> DataFrame:
    texts = items.select(order, "content", "source_name")
    extra = F.concat(separator(F.col("source_name")), F.col("content"))
    piece = F.when(F.col(order) == F.col("lead"), text_or_empty("content")).otherwise(extra)
    return placed.join(texts, order).withColumn("piece", piece).drop("content", "source_name")


def combine_pieces(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """Combined text of every group as pieces: ``group_id``, ``position`` from 0, ``piece``, ``order``.

    The winner's content comes first, then the other members' distinct contents in rank
    order; joined by position they are the text. Members are range-partitioned by group and
    rank, so a group of any size spreads over tasks; what a range needs to know of the ones
    before it is one row per group and range. Contents enter in the last join.
    """
    return _with_texts(_placed(items, groups, order), items, order).select("group_id", "position", "piece", order)


def merge_pieces(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """``merge_combine`` for groups of any size: a row per piece of ``combine_pieces``, with the winner's fields.

    ``group_id``, ``position``, ``piece`` and the clean columns but the content.
    """
    fields = tuple(c for c in CLEAN_COLUMNS if c != "content")
    return _with_texts(_placed(items, groups, order, fields), items, order).select("group_id", "position", *fields, "piece")


def fold_pieces(pieces: DataFrame) -> DataFrame:
    """Each group's pieces joined to one string: ``group_id``, ``content``.

    A separate step, for groups whose text is known to fit into a row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("position", "piece")))
    folded = pieces.groupBy("group_id").agg(ordered.alias("pieces"))
    return folded.select("group_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("content"))


def merge_combine(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """One article per group: the winner, with the other members' distinct contents appended.

    A group's text has to fit into a row (2 GB) and an executor; ``merge_pieces`` has no such limit.
    The winner's fields meet its text where it is folded, so texts move once, as pieces.
    """
    pieces = materialize(combine_pieces(items, groups, order))
    others = items.select(order, *[c for c in CLEAN_COLUMNS if c != "content"])
    heads = pieces.where("position = 0").select("group_id", order).join(others, order)
    return fold_pieces(pieces).join(heads, "group_id").select(*CLEAN_COLUMNS)


def aggregate_sources(
    items: DataFrame, strategy: str = "priority", semantics: str = "greedy", order: str = "arrival", **grouping
) -> DataFrame:
    """Group duplicates across sources and merge each group; unknown strategies act as ``priority``.

    ``combine`` gives a row per article, so a group's text has to fit into one; ``pieces`` gives
    the same texts in the rows of ``merge_pieces``, for groups of any size.
    """
    groups = group_duplicates(items, semantics, order=order, **grouping)
    if strategy == "combine":
        return merge_combine(items, groups, order)
    if strategy == "pieces":
        return merge_pieces(items, groups, order)
    return merge_priority(items, groups, order)
