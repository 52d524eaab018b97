"""Content stages chained into one plan, with failures isolated per article."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions import lexicons as lex, text as X
from feedlake.operators.analysis import analyze
from feedlake.operators.enrich import ProviderFactory, enrich_with_providers

# Stage names, as they stand in results, are part of the format.
FAILURE = "struct<stage:string,error:string,critical:boolean>"


@dataclass(frozen=True)
class Stage:
    """One step.

    ``prepare`` adds whatever columns the step needs, ``outputs`` gives new values for
    article columns, ``error`` tells per article why it failed (null: it did not).
    A failed critical stage ends the article with status ``failed``; after any other
    failure ``fallback`` values apply, by default the old ones.
    """

    name: str
    outputs: Mapping[str, Column]
    critical: bool = True
    error: Column | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    fallback: Mapping[str, Column] = field(default_factory=dict)


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Apply ``stages`` in order; adds ``pipeline_run`` (stages_executed, failures).

    No action happens between stages. Conditions appear in the plan only once a stage
    that can fail has come by.
    """
    state = df.withColumns(
        {"_executed": F.array().cast("array<string>"), "_failures": F.array().cast(f"array<{FAILURE}>"), "_halted": F.lit(False)}
    )
    can_halt = False
    for stage in stages:
        state = _apply(state, stage, can_halt)
        can_halt = can_halt or (stage.error is not None and stage.critical)
    run = F.struct(F.col("_executed").alias("stages_executed"), F.col("_failures").alias("failures"))
    return state.withColumn("pipeline_run", run).drop("_executed", "_failures", "_halted")


def _apply(state: DataFrame, stage: Stage, can_halt: bool) -> DataFrame:
    columns = state.columns
    ready = stage.prepare(state) if stage.prepare else state
    active = ~F.col("_halted") if can_halt else F.lit(True)
    failed = F.lit(False) if stage.error is None else active & stage.error.isNotNull()
    changes: dict[str, Column] = {}
    for name, value in stage.outputs.items():
        old = F.col(name) if name in columns else F.lit(None)
        changes[name] = F.when(failed, stage.fallback.get(name, old)).when(active, value).otherwise(old)
    changes["_executed"] = F.when(active, F.array_append("_executed", F.lit(stage.name))).otherwise(F.col("_executed"))
    if stage.error is not None:
        entry = F.struct(F.lit(stage.name).alias("stage"), stage.error.alias("error"), F.lit(stage.critical).alias("critical"))
        changes["_failures"] = F.when(failed, F.array_append("_failures", entry)).otherwise(F.col("_failures"))
        if stage.critical:
            changes["_halted"] = F.col("_halted") | failed
            status = changes.get("rewrite_status", F.col("rewrite_status"))
            changes["rewrite_status"] = F.when(failed, F.lit("failed")).otherwise(status)
    result = ready.withColumns(changes)
    return result.select(*columns, *[c for c in stage.outputs if c not in columns])


def sanitize_stage(critical: bool = True) -> Stage:
    return Stage(
        "SanitizationStage", {"title": X.sanitize_title("title"), "content": X.sanitize_content("content")}, critical
    )


def rewrite_stage(text: Column, critical: bool = True) -> Stage:
    """Rewriting by template."""
    return Stage("RewriteStage", {"rewritten_content": text, "rewrite_status": F.lit("completed")}, critical)


def provider_stage(providers: Mapping[str, ProviderFactory], critical: bool = True, **retry) -> Stage:
    """Rewriting by external providers; an article fails when all of them do."""

    def prepare(df: DataFrame) -> DataFrame:
        asked = df.withColumn("_prompt", X.prompt("title", "content"))
        return enrich_with_providers(asked, "_prompt", providers, keep_input=False, **retry)

    return Stage(
        "RewriteStage",
        {"rewritten_content": F.col("text"), "rewrite_status": F.lit("completed")},
        critical,
        error=F.when(F.col("provider_used").isNull(), F.get("errors", F.size("errors") - 1)),
        prepare=prepare,
    )


def translate_stage(translation: Column, critical: bool = False) -> Stage:
    """``translation`` replaces the rewritten text; empty and null texts stay as they are."""
    text = F.when(X.is_filled(F.col("rewritten_content")), translation).otherwise(F.col("rewritten_content"))
    return Stage("TranslationStage", {"rewritten_content": text}, critical)


def analysis_stage(enabled: bool = True, critical: bool = False, **lexicons) -> Stage:
    """All analyses over the title and the rewritten text, or the content where there is none."""
    if not enabled:
        return Stage("ContentAnalysisStage", {}, critical)
    text = F.coalesce(F.nullif("rewritten_content", F.lit("")), F.col("content"))
    return Stage(
        "ContentAnalysisStage",
        {"intelligence": F.col("_intelligence")},
        critical,
        prepare=lambda df: analyze(df, "title", text, "_intelligence", **lexicons),
    )


def tagging_stage(keywords=lex.TAG_KEYWORDS, critical: bool = False) -> Stage:
    tags = X.tag_keywords("title", "content", keywords)
    return Stage("MetadataTaggingStage", {"rewritten_content": X.append_tags("rewritten_content", tags)}, critical)


def default_stages(rewritten: Column | None = None, translation: Column | None = None, analysis: bool = True) -> list[Stage]:
    """All stages; without a rewrite the content is taken, without a translation that stage is left out."""
    steps = [sanitize_stage(), rewrite_stage(F.col("content") if rewritten is None else rewritten)]
    steps += [] if translation is None else [translate_stage(translation)]
    return [*steps, analysis_stage(analysis), tagging_stage()]


def process_articles(
    articles: DataFrame, stages: Sequence[Stage], duration_seconds: Column | None = None, completed_at: Column | None = None
) -> DataFrame:
    """Articles through ``stages`` with ``pipeline_metadata`` filled.

    The stages of all articles run fused in one plan, so there is no time per article;
    the duration is the batch's and comes from the caller.
    """
    done = run_stages(articles, stages)
    run = F.struct(
        F.col("pipeline_run.stages_executed").alias("stages_executed"),
        F.col("pipeline_run.failures").alias("failures"),
        (F.lit(None) if duration_seconds is None else duration_seconds).cast("double").alias("duration_seconds"),
        (F.current_timestamp() if completed_at is None else completed_at).alias("completed_at"),
    )
    fields = [run.alias("pipeline_run")]
    if "intelligence" in done.columns:
        fields.append(F.col("intelligence"))
    return done.withColumn("pipeline_metadata", F.struct(*fields)).drop("pipeline_run", "intelligence")
