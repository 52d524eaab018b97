"""Tools for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.session import materialize

#: No key with more rows than this is handled by one window, at any table size.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, n_rows: int, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows; None when no key can have as many.

    There are at most ``n_rows / hot_rows`` of them, so the list is small beside the table but grows with it.
    """
    if n_rows <= hot_rows:
        return None
    return df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)


def order_blocks(df: DataFrame, order: str, block: str, blocks: int) -> DataFrame:
    """Write ``df`` with a column numbering equal-sized ranges of ``order``.

    The number is stored, so later plans read it instead of deriving it again.
    """
    ranged = df.repartitionByRange(blocks, order).withColumn(block, F.spark_partition_id())
    return materialize(ranged)


def salt_hot(df: DataFrame, key: str, block: str, salt: str, hot: DataFrame | None) -> DataFrame:
    """``salt`` = the block for rows of hot keys, -1 for all others.

    Spark broadcasts the list while it is below its size limit. Beyond that it joins by key, and adaptive
    execution splits the hot keys' rows.
    """
    if hot is None:
        return df.withColumn(salt, F.lit(-1))
    flagged = df.join(hot.withColumn("is_hot", F.lit(True)), key, "left")
    return flagged.withColumn(salt, F.when(F.col("is_hot"), F.col(block)).otherwise(F.lit(-1))).drop("is_hot")


def min_per_key(
    df: DataFrame, key: str, salt: str, value: str, out: str, order: str | None, any_hot: bool
) -> DataFrame:
    """Smallest ``value`` of the key, up to the current row of ``order`` if one is given.

    Rows of a hot key are spread over its salts, which follow ``order``. What the earlier
    salts contribute comes from one row per (key, salt), joined on the partitioning the
    window has already made.
    """
    inside = W.partitionBy(key, salt) if any_hot else W.partitionBy(key)
    across = W.partitionBy(key)
    if order is not None:
        inside = inside.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        across = across.orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn(out, F.min(value).over(inside))
    if not any_hot:
        return local
    carried = (
        df.where(F.col(salt) >= 0)
        .groupBy(key, salt)
        .agg(F.min(value).alias("block_min"))
        .select(key, salt, F.min("block_min").over(across).alias("carried"))
    )
    joined = local.join(carried, [key, salt], "left")
    return joined.withColumn(out, F.least(F.col(out), F.col("carried"))).drop("carried")
