"""Upserts, lookups, listings and checks over the article, source, user and session tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.functions.lexicons import ROLE_PERMISSIONS, ROUTE_PERMISSIONS
from feedlake.functions.timestamps import iso_text

# What a conflicting article write overwrites.
ARTICLE_UPDATE_COLUMNS = ["title", "content", "rewritten_content", "rewrite_status", "published_outputs", "pipeline_metadata"]


def latest_per_key(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """Last write per key; pruned to one row per key and task before the shuffle."""
    if order is None:
        return df
    newest = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert or replace whole rows. Without ``order`` the updates must have unique keys."""
    fresh = latest_per_key(updates, key, order).select(*target.columns)
    return target.join(fresh.select(key), key, "left_anti").select(*target.columns).unionByName(fresh)


def upsert_partial(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    update_columns: Sequence[str] = ARTICLE_UPDATE_COLUMNS,
    order: str | None = None,
) -> DataFrame:
    """Insert new rows; of known rows overwrite ``update_columns`` only, nulls included.

    A left join instead of a full outer one: a small batch is then broadcast by Spark and
    the target is not shuffled. The new rows come from an anti-join on the keys alone.
    """
    fresh = latest_per_key(updates, key, order).select(*target.columns)
    news = fresh.select(
        F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in target.columns if c in update_columns]
    )
    kept = target.join(news, key, "left").select(
        *[
            F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update_columns else F.col(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(fresh.join(target.select(key), key, "left_anti").select(*target.columns))


def get_by_key(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def find_user(users: DataFrame, username: str) -> DataFrame:
    return get_by_key(users, "username", username)


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def skip_completed(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items that have an id and are not stored as completed."""
    done = articles.where("rewrite_status = 'completed'").select("id")
    named = items.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return named.join(done, "id", "left_anti").select(*items.columns)


def list_articles(articles: DataFrame) -> DataFrame:
    columns = [
        "id", "source_id", "title", "content", "original_url", "rewritten_content",
        "rewrite_status", "published_outputs", "pipeline_metadata",
    ]
    present = [c for c in columns if c in articles.columns]
    return articles.select(*present, iso_text("published_at").alias("published_at"))


def list_feed(articles: DataFrame) -> DataFrame:
    """The listing signed-in readers get."""
    return list_articles(articles).drop("source_id", "published_outputs")


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select(
        "id", "url", "name", "enabled", iso_text("last_fetched_at").alias("last_fetched_at"), "priority",
        "weight", "reliability_score", "fetch_count", "success_count", "failure_count", "last_error",
    )


PAGE_COLUMNS = ["id", "title", "content", "published_at", "rewrite_status", "pipeline_metadata"]


def paginate(df: DataFrame, page: int = 1, limit: int = 10, order_by: str = "id") -> DataFrame:
    """One page in the order of the unique column ``order_by``, with the total row count.

    The page's keys are found on the key column alone, then their rows are fetched and
    sorted: rows are counted per key range, and only the ranges the page touches are ranked.
    """
    if page < 1 or limit < 1:
        raise ValueError("page and limit must be at least 1")
    columns = [c for c in PAGE_COLUMNS if c in df.columns]
    keys, total = _page_keys(df, order_by, (page - 1) * limit, limit)
    return df.join(keys, order_by).select(*columns).orderBy(order_by).withColumn("total", F.lit(total).cast("long"))


def _page_keys(df: DataFrame, key: str, start: int, limit: int) -> tuple[DataFrame, int]:
    """The at most ``limit`` keys on positions ``start`` and after, stored, and the number of rows."""
    from feedlake.session import materialize

    keys = materialize(df.select(key).repartitionByRange(key).withColumn("_slot", F.spark_partition_id()))
    # One row per shuffle partition.
    sizes = sorted((r["_slot"], r["count"]) for r in keys.groupBy("_slot").count().collect())
    before, touched, skipped = 0, [], None
    for slot, size in sizes:
        if before + size > start and before < start + limit:
            touched.append(slot)
            skipped = before if skipped is None else skipped
        before += size
    inside = keys.where(F.col("_slot").isin(touched))
    ranked = inside.withColumn("_at", F.row_number().over(W.partitionBy("_slot").orderBy(key)))
    offsets, seen = {}, 0
    for slot, size in sizes:
        offsets[slot] = seen
        seen += size
    if not touched:
        return keys.select(key).limit(0), before
    base = F.create_map(*[F.lit(v) for s in touched for v in (s, offsets[s])])
    position = F.element_at(base, F.col("_slot")) + F.col("_at") - 1
    return materialize(ranked.where((position >= start) & (position < start + limit)).select(key)), before


def paginate_after(df: DataFrame, last_key, limit: int = 10, order_by: str = "id") -> DataFrame:
    """Next page by key: a pushed-down filter and a top-k, whatever the depth."""
    rows = df if last_key is None else df.where(F.col(order_by) > F.lit(last_key))
    return rows.orderBy(order_by).limit(limit)


def article_stats(articles: DataFrame, sources: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("articles_total"),
        F.count_if(F.col("rewrite_status") == "completed").alias("rewrites_completed"),
    ).withColumn("sources_total", sources.agg(F.count("*")).scalar())


def status_breakdown(articles: DataFrame) -> DataFrame:
    return articles.groupBy("rewrite_status").agg(F.count("*").alias("n"))


def evolve_schema(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are missing and fill the nulls of those that are not."""
    return df.withColumns(
        {name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in defaults.items()}
    )


def valid_sessions(sessions: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Sessions still valid at an instant, with their user. No expiry means never."""
    live = sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= at))
    people = users.select(F.col("id").alias("user_id"), "username", "role")
    return live.join(people, "user_id")


def required_permission(path: Column, routes: Mapping[str, str] = ROUTE_PERMISSIONS) -> Column:
    """Permission a path asks for; null where it is open. ``/*`` matches everything below."""
    result = F.lit(None).cast("string")
    for route, permission in routes.items():
        hit = F.startswith(path, F.lit(route[:-1])) if route.endswith("/*") else path == route
        result = F.when(hit, F.lit(permission)).otherwise(result)
    return result


def authorize(
    requests: DataFrame,
    users: DataFrame,
    roles: Mapping[str, Sequence[str]] = ROLE_PERMISSIONS,
    routes: Mapping[str, str] = ROUTE_PERMISSIONS,
) -> DataFrame:
    """Adds the permission a request needs and the status it gets: 200, 401 or 403."""
    people = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"), F.coalesce("role", F.lit("viewer")).alias("role"))
    needs = required_permission(F.col("path"), routes)
    granted = F.lit(False)
    for role, permissions in roles.items():
        granted = granted | ((F.col("role") == role) & F.col("permission").isin(list(permissions)))
    status = (
        F.when(F.col("permission").isNull(), F.lit(200))
        .when(F.col("_known").isNull(), F.lit(401))
        .when(F.coalesce(granted, F.lit(False)), F.lit(200))
        .otherwise(F.lit(403))
    )
    return requests.join(people, "user_id", "left").withColumn("permission", needs).withColumn("status", status).drop("_known")


def check_unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
