"""All analyses of an article in one pass over its text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions import analytics as A, lexicons as lex
from feedlake.functions.text import lexicon_tokens, text_or_empty, tokens


def analyze(
    df: DataFrame,
    title: Column | str = "title",
    content: Column | str = "content",
    out: str = "intelligence",
    positive: Sequence[str] = lex.POSITIVE_WORDS,
    negative: Sequence[str] = lex.NEGATIVE_WORDS,
    weights: Mapping[str, float] = lex.URGENCY_WEIGHTS,
    topic_limit: int = 5,
) -> DataFrame:
    """Adds one struct: language, sentiment, readability, topics, agent_signals.

    The steps are stacked projections, so the text is tokenized once and each result is
    computed once; the plan has no exchange.
    """
    text = F.concat(text_or_empty(title), F.lit(" "), text_or_empty(content))
    staged = df.withColumn("_text", text)
    staged = staged.withColumn("_words", lexicon_tokens("_text"))
    words, listed = F.col("_words"), F.col("_listed")
    lists = (positive, negative, lex.ENGLISH_STOP_WORDS, lex.PERSIAN_STOP_WORDS)
    staged = staged.withColumn("_listed", A.words_of_lexicons(words, *lists))
    # The two word lists differ only where the dotted capital I occurs.
    topic_words = F.when(F.contains("_text", F.lit("\u0130")), tokens("_text")).otherwise(words)
    staged = staged.withColumns(
        {
            "_language": A.detect_language("_text", listed),
            "_sentiment": A.analyze_sentiment("_text", listed, positive, negative),
            "_readability": A.analyze_readability("_text"),
            "_topic_words": topic_words,
        }
    ).withColumn("_topics", A.extract_topics("_text", "_language", topic_limit, F.col("_topic_words")))
    staged = add_agent_signals(staged, F.col("_text"), F.col("_sentiment.score"), "_signals", weights)
    result = F.struct(
        F.col("_language").alias("language"),
        F.col("_sentiment").alias("sentiment"),
        F.col("_readability").alias("readability"),
        F.col("_topics").alias("topics"),
        F.col("_signals").alias("agent_signals"),
    )
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != out], result.alias(out))


def add_agent_signals(
    df: DataFrame, text: Column, score: Column, out: str, weights: Mapping[str, float] = lex.URGENCY_WEIGHTS
) -> DataFrame:
    """Routing signals of ``text`` in stacked projections, numbers staying in generated code."""
    steps = df.withColumns(
        {"_triggers": A.matched_triggers(text, weights), "_impact": A.sentiment_impact(score), "_blank": text_or_empty(text) == ""}
    )
    steps = steps.withColumn("_urgency", A.urgency_score(F.col("_triggers"), weights))
    steps = steps.withColumn("_priority", A.capped_rating(0.2, F.col("_urgency"), F.col("_impact")))
    parts = [F.col(c) for c in ("_triggers", "_urgency", "_impact", "_priority", "_blank")]
    return steps.withColumn(out, A.signals_from_parts(*parts)).drop("_triggers", "_urgency", "_impact", "_priority", "_blank")
