"""Mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.llm.common import WORD_PATTERN, fresh
from feedlake.session import materialize

CYCLE = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix"


def n_words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` by code point, null last, from 0.

    Sources are range-partitioned and numbered inside their range, so their number is not
    bounded by one task; only one count per range is summed up in a single place.
    """
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()))
    starts = ranged.groupBy("part").count().select(
        "part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before")
    )
    inside = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, "part")
        .select("source", "source_size", (F.col("at") + F.col("before")).alias("rank"))
    )


@dataclass
class _Level:
    """Tokens and weight left for the sources that are not at their cap."""

    tokens: int
    weight: int


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """Target and repetition rate of each source.

    ``sizes`` has (source, size). Weights repeat ``cycle`` over the sources in code point
    order, null last. All tokens are shared by weight; a target above ``most`` times its
    source's size stops there and the excess is shared again, until none is above. Returns
    (source, source_size, target, rate); a source without tokens has target and rate 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*(F.lit(w) for w in cycle))
    table = materialize(
        _ranked(sources).select(
            "source", "source_size",
            F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * most).alias("cap"),
        )
    )
    first = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, total = _Level(first[0] or 0, first[1] or 0), first[0] or 0
    while level.weight:
        at_cap = _at_cap(level)
        row = table.agg(
            F.sum(F.when(at_cap, F.col("cap")).otherwise(0)), F.sum(F.when(at_cap, 0).otherwise(F.col("weight")))
        ).first()
        following = _Level(total - row[0], row[1])
        if following == level:
            break
        level = following
    share = F.lit(float(level.tokens)) * F.col("weight") / F.lit(float(max(level.weight, 1)))
    capped = _at_cap(level) if level.weight else F.lit(True)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return materialize(
        table.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")
    )


def _at_cap(level: _Level) -> Column:
    wide = "decimal(38,0)"
    return F.lit(level.tokens).cast("decimal(19,0)") * F.col("weight").cast("decimal(10,0)") >= (
        F.col("cap").cast("decimal(19,0)") * F.lit(level.weight).cast("decimal(18,0)")
    ).cast(wide)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone; null counts as the empty text."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def n_copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with probability equal to the fraction."""
    extra = F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)
    return F.floor(rate) + extra


def copy_counts(
    docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES, seed: str = SEED
) -> DataFrame:
    """Per document (doc_id, source, size, source_size, target, copies).

    Null text: size 0. Null source: a source of its own. Equal ids get equal draws. An empty
    table gives no rows. Other columns of ``docs`` are not looked at.
    """
    sizes = docs.select("doc_id", "source", n_words("text").alias("size"))
    targets = source_targets(sizes, cycle, most).withColumnRenamed("source", "of_source")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    copies = n_copies(F.col("rate"), F.col("doc_id"), seed).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as many times as ``copy_counts`` says, columns unchanged.

    The rates are a stored table, one row per source, so Spark knows its size when it plans
    the join: texts stay where they are if it is small, and skewed sources are split if not.
    """
    key, rate = fresh(docs, "mix_source", "mix_rate")
    sizes = docs.select("source", n_words("text").alias("size"))
    rates = source_targets(sizes, cycle, most).select(F.col("source").alias(key), F.col("rate").alias(rate))
    times = n_copies(F.col(rate), docs["doc_id"], seed).cast("int")
    return (
        docs.join(rates, docs["source"].eqNullSafe(F.col(key)))
        .withColumn(rate, times)
        .where(F.col(rate) > 0)
        .withColumn(key, F.explode(F.sequence(F.lit(1), F.col(rate))))
        .select(*docs.columns)
    )
