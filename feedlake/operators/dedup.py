"""Exact duplicates, and duplicate groups over ids and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.functions.text import normalize_title, text_or_empty
from feedlake.operators import skew
from feedlake.session import materialize, release


def content_hash(c):
    return F.sha2(text_or_empty(c), 256)


def dedup_exact(df: DataFrame, text: str = "content", order: str = "arrival") -> DataFrame:
    """First row per text, by ``order``.

    The rank filter prunes to one row per hash before the shuffle, so a text copied a
    billion times sends one row per task.
    """
    first = W.partitionBy("content_sha").orderBy(order)
    hashed = df.withColumn("content_sha", content_hash(text))
    return hashed.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def group_duplicates(
    items: DataFrame,
    semantics: str = "greedy",
    id_col: str = "id",
    title_col: str = "title",
    order: str = "arrival",
    hot_rows: int = skew.HOT_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Duplicate group of every item: ``order``, ``group_id``.

    Items belong together when they share an id or a non-empty normalized title.
    ``group_id`` is the ``order`` value of the group's first item; ``order`` must be
    unique.

    ``greedy``: an item, in ``order``, joins the oldest group that holds its id or title,
    or founds a group. A key that has been seen always leads to the oldest group seen
    with it, so an item's group is the smallest label among the items it can reach
    backwards, from item to an earlier item with the same id or title. That is a fixed
    point: take the running minimum along each id, then along each title, until nothing
    changes. No group is ever gathered in one task.

    ``transitive``: whole connected components, the same loop with the minimum over the
    whole key.

    Only order, id and title hash take part; text stays where it is.
    """
    title = normalize_title(title_col)
    pos = F.col(order).cast("long")
    # An item without a title gets a title key of its own.
    nodes = items.select(
        pos.alias("pos"),
        text_or_empty(id_col).alias("id_key"),
        F.when(title != "", F.unhex(F.sha2(title, 256))).otherwise(F.encode(pos.cast("string"), "UTF-8")).alias("title_key"),
        pos.alias("label"),
    )
    return settle_labels(nodes, semantics, hot_rows, blocks).select(F.col("pos").alias(order), F.col("label").alias("group_id"))


def settle_labels(
    nodes: DataFrame, semantics: str = "greedy", hot_rows: int = skew.HOT_ROWS, blocks: int | None = None
) -> DataFrame:
    """``nodes`` (pos, id_key, title_key, label) with labels lowered along both keys until nothing changes.

    Rows below all others may come with labels from earlier runs; they may share a ``pos``
    below 0 if rows with a key in common have the same label.
    """
    if semantics not in ("greedy", "transitive"):
        raise ValueError(f"unknown semantics: {semantics}")
    spark = nodes.sparkSession
    along = "pos" if semantics == "greedy" else None
    nodes = written = materialize(nodes.select("pos", "id_key", "title_key", "label"))
    n_rows = nodes.count()

    hot, any_hot = {}, {}
    for key in ("id_key", "title_key"):
        found = skew.hot_keys(nodes, key, n_rows, hot_rows)
        hot[key] = None if found is None else materialize(found)
        any_hot[key] = found is not None and not hot[key].isEmpty()
    if any(any_hot.values()):
        blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // hot_rows))
        nodes = written = _replace(written, skew.order_blocks(nodes, "pos", "block", blocks))
    else:
        nodes = nodes.withColumn("block", F.lit(-1))
    for key, salt in (("id_key", "id_salt"), ("title_key", "title_salt")):
        nodes = skew.salt_hot(nodes, key, "block", salt, hot[key] if any_hot[key] else None)
    state = nodes.drop("block")

    def sweep(df: DataFrame, value: str, out: str) -> DataFrame:
        by_id = skew.min_per_key(df, "id_key", "id_salt", value, "by_id", along, any_hot["id_key"])
        return skew.min_per_key(by_id, "title_key", "title_salt", "by_id", out, along, any_hot["title_key"]).drop("by_id")

    # Two sweeps per written table: when the second changes nothing the labels are final.
    # With hot keys a sweep reads its input twice, so there each one is written.
    final, step = False, 0
    while not final:
        step += 1
        if any(any_hot.values()):
            after = sweep(state, "label", "new_label").withColumnRenamed("label", "old_label")
        else:
            once = sweep(state, "label", "old_label").drop("label")
            after = sweep(once, "old_label", "new_label")
        after = after.withColumnRenamed("new_label", "label")
        if step > 1:
            after = _follow_labels(after)
        after = written = _replace(written, materialize(after))
        final = after.where("label < old_label").isEmpty()
        state = after.drop("old_label")
    return state.select("pos", "id_key", "title_key", "label")


def _replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` is written, so the table it was made from can go."""
    release(old)
    return new


def _follow_labels(state: DataFrame) -> DataFrame:
    """Replace each label by the label of the item it names; halves long chains."""
    moved = state.where("label < pos").select(F.col("pos").alias("label"), F.col("label").alias("next_label"))
    return state.join(moved, "label", "left").withColumn(
        "label", F.least(F.col("label"), F.col("next_label"))
    ).drop("next_label")


def duplicate_report(items: DataFrame, groups: DataFrame, order: str = "arrival") -> DataFrame:
    """Size of each group with more than one item, and how many sources it spans."""
    from feedlake.operators.merge import winners

    members = items.select(order, "source_id").join(groups, order)
    sizes = (
        members.groupBy("group_id", "source_id").agg(F.count("*").alias("n"))
        .groupBy("group_id").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_sources"))
        .where("n_items > 1")
    )
    best = winners(items, groups, order).join(items.select(order, "id", "title"), order)
    return sizes.join(best.select("group_id", "id", "title"), "group_id")
