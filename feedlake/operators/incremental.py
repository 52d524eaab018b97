"""Duplicate groups that grow batch by batch, and their articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.functions.text import normalize_title, text_or_empty
from feedlake.operators import skew
from feedlake.operators.dedup import settle_labels
from feedlake.operators.merge import CLEAN_COLUMNS, RANKS, rank_columns
from feedlake.session import materialize

#: Rows that stand for stored keys come before every item.
SEED = -1


@dataclass(frozen=True)
class GrownGroups:
    """``groups``: order, group_id of the batch's items. ``keys``: key, label as they now are.
    ``moved``: label, into for stored groups that the batch joined to an older one."""

    groups: DataFrame
    keys: DataFrame
    moved: DataFrame


def item_nodes(items: DataFrame, id_col: str = "id", title_col: str = "title", order: str = "arrival") -> DataFrame:
    """(pos, id_key, title_key, label): an item without a title has a title key of its own."""
    title = normalize_title(title_col)
    pos = F.col(order).cast("long")
    return items.select(
        pos.alias("pos"),
        F.concat(F.lit("i"), text_or_empty(id_col)).alias("id_key"),
        F.when(title != "", F.unhex(F.sha2(title, 256))).otherwise(F.encode(pos.cast("string"), "UTF-8")).alias("title_key"),
        pos.alias("label"),
    )


def _stored_keys(nodes: DataFrame) -> DataFrame:
    """(key, label) of every id and title among ``nodes``, as text."""
    ids = nodes.where(F.startswith("id_key", F.lit("i"))).select(F.col("id_key").alias("key"), "label")
    titled = nodes.where(F.octet_length("title_key") == 32)
    titles = titled.select(F.concat(F.lit("t"), F.lower(F.hex("title_key"))).alias("key"), "label")
    return ids.unionByName(titles).groupBy("key").agg(F.min("label").alias("label"))


def keys_of(nodes: DataFrame) -> DataFrame:
    """Distinct ids and titles of a batch's nodes, in the form they are stored."""
    return _stored_keys(nodes).select("key")


def grow_groups(
    nodes: DataFrame, known: DataFrame, semantics: str = "greedy", order: str = "arrival", hot_rows: int = skew.HOT_ROWS
) -> GrownGroups:
    """Groups of a batch's ``item_nodes``, given the labels of those of its keys that are stored.

    ``known`` (key, label) is all that is read of earlier batches. A stored key takes part as a row before
    all items that carries its label; rows with one label are held together by a key of their own. So the
    groups are those of one run over all batches, as long as a later batch has greater ``order`` values.
    Under ``greedy`` stored groups never change; under ``transitive`` an item can join them.
    """
    seed, label = F.lit(SEED).cast("long").alias("pos"), F.col("label")
    own = F.concat(F.lit("g"), label.cast("string"))
    is_id = F.startswith("key", F.lit("i"))
    seeds = known.select(
        seed,
        F.when(is_id, F.col("key")).otherwise(own).alias("id_key"),
        F.when(is_id, F.encode(own, "UTF-8")).otherwise(F.unhex(F.substring("key", 2, 64))).alias("title_key"),
        "label",
    )
    bridges = known.select("label").distinct().select(seed, own.alias("id_key"), F.encode(own, "UTF-8").alias("title_key"), "label")
    settled = settle_labels(nodes.unionByName(seeds).unionByName(bridges), semantics, hot_rows)
    items = settled.where(F.col("pos") > SEED)
    bridge = settled.where((F.col("pos") == SEED) & (F.encode("id_key", "UTF-8") == F.col("title_key")))
    stored = bridge.select(F.substring("id_key", 2, 20).cast("long").alias("label"), F.col("label").alias("into"))
    return GrownGroups(
        items.select(F.col("pos").alias(order), F.col("label").alias("group_id")),
        _stored_keys(settled),
        stored.where("into < label"),
    )


def ranked_candidates(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """The best item of each group of a batch, without texts: group_id, ``order`` and the rank columns."""
    ranked = items.select(order, *rank_columns()).join(groups, order)
    best = W.partitionBy("group_id").orderBy(*RANKS, order)
    return ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("group_id", order, *RANKS)


def best_of(stored: DataFrame, candidates: DataFrame, order: str = "arrival") -> DataFrame:
    """The better of a group's stored winner and its candidates, for every group of ``candidates``, without texts.

    Ranks are those at the time of each item's fetch, so the winner is a minimum and batches may be split anyhow.
    """
    columns = ["group_id", order, *RANKS]
    both = stored.select(*columns).unionByName(candidates.select(*columns))
    best = W.partitionBy("group_id").orderBy(*RANKS, order)
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def with_contents(chosen: DataFrame, texts: DataFrame, order: str = "arrival") -> DataFrame:
    """``chosen`` items (group_id, ``order``, ...) with their clean columns out of ``texts``, which move once, in this join.

    One row per chosen item, also if ``order`` repeats among the texts.
    """
    found = chosen.join(texts.select(order, *CLEAN_COLUMNS), order)
    one = W.partitionBy(order, "group_id").orderBy("id")
    return found.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*chosen.columns, *CLEAN_COLUMNS)


def follow(labels: DataFrame, moves, column: str = "label") -> DataFrame:
    """``labels`` with ``column`` moved along ``moves(labels)`` (label, into) until none of them moves on."""
    while True:
        step = materialize(moves(labels.select(F.col(column).alias("label")).distinct()))
        if step.isEmpty():
            return labels
        step = step.select(F.col("label").alias(column), F.col("into").alias("_into"))
        moved = labels.join(step, column, "left").withColumn(column, F.coalesce("_into", column)).drop("_into")
        labels = materialize(moved.select(*labels.columns))
