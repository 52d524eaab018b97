"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.llm import (
    decontaminate, html_text, jaccard_join, language_id, lexical_search, mixing, periodic_runs, quality_classifier,
    quality_rules, secret_scan, substring_dedup, suffix_dedup, token_files,
)
from feedlake.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.copy_counts(_table(spark, sf_dir, "documents"))
    return counted.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, trees).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.link_documents(docs).select("doc_id", "n_shingles", "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.run_digests(periodic_runs.runs_of_texts(docs, periodic_runs.repeat_tail))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_html_text": op8_html_text,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}
