"""Language, sentiment, readability, topics and routing signals of one text.

Each function is a projection: no shuffle, whatever the text length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from feedlake.functions import lexicons as lex
from feedlake.functions.rounding import round_exact
from feedlake.functions.text import _col, lexicon_tokens, plain_spaces, text_or_empty, tokens

SENTENCE_ENDS = ".!?\u06d4"


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_hits(words: Column, lexicon: Sequence[str]) -> Column:
    """How many of ``words`` are in ``lexicon``, counted per occurrence."""
    entries = list(lexicon)
    return F.size(F.filter(words, lambda w: w.isin(entries)))


def words_of_lexicons(words: Column, *lexicons: Sequence[str]) -> Column:
    """The ``words`` that are in any of ``lexicons``, for several counts after one pass."""
    entries = [*dict.fromkeys(w for lexicon in lexicons for w in lexicon)]
    return F.filter(words, lambda w: w.isin(entries))


def persian_share(c: Column | str) -> Column:
    text = text_or_empty(c)
    # The outer range spares most characters the look at the inner ones.
    others = F.length(F.regexp_replace(text, f"[\u0600-\uFEFF&&[{lex.PERSIAN_RANGES}]]+", ""))
    return F.coalesce(F.try_divide(F.length(text) - others, F.length(text)), F.lit(0.0))


def detect_language(
    c: Column | str,
    words: Column | None = None,
    english: Sequence[str] = lex.ENGLISH_STOP_WORDS,
    persian: Sequence[str] = lex.PERSIAN_STOP_WORDS,
) -> Column:
    """``fa`` by share of letters, else by stop words, else ``en``."""
    if words is None:
        return _let(lexicon_tokens(text_or_empty(c)), lambda w: detect_language(c, w, english, persian))
    by_stop_words = F.when(count_hits(words, persian) > count_hits(words, english), F.lit("fa")).otherwise(F.lit("en"))
    return F.when(persian_share(c) > 0.15, F.lit("fa")).otherwise(by_stop_words)


def sentiment_ratio(positive: Column, negative: Column) -> Column:
    total = positive + negative
    return F.when(total > 0, (positive - negative) / total).otherwise(F.lit(0.0))


def sentiment_label(ratio: Column) -> Column:
    return (
        F.when(ratio > 0.15, F.lit("positive"))
        .when(ratio < -0.15, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def sentiment_from_hits(positive: Column, negative: Column) -> Column:
    """The label comes from the unrounded score."""
    def from_ratio(v: Column) -> Column:
        return F.struct(
            round_exact(v["ratio"], 2).alias("score"), sentiment_label(v["ratio"]).alias("label"), v["details"].alias("details")
        )

    details = F.struct(positive.alias("positive_hits"), negative.alias("negative_hits"))
    return _let(F.struct(sentiment_ratio(positive, negative).alias("ratio"), details.alias("details")), from_ratio)


def analyze_sentiment(
    c: Column | str,
    words: Column | None = None,
    positive: Sequence[str] = lex.POSITIVE_WORDS,
    negative: Sequence[str] = lex.NEGATIVE_WORDS,
) -> Column:
    if words is None:
        return _let(lexicon_tokens(text_or_empty(c)), lambda w: analyze_sentiment(c, w, positive, negative))
    hits = F.struct(count_hits(words, positive).alias("p"), count_hits(words, negative).alias("n"))
    return _let(hits, lambda h: sentiment_from_hits(h["p"], h["n"]))


def _filled(pieces: Column) -> Column:
    return F.size(F.array_remove(pieces, ""))


def readability_from_text(plain: Column) -> Column:
    """Counts for text whose whitespace is all spaces."""

    def from_counts(v: Column) -> Column:
        words = v["words"]
        # The order of the two double operations decides the last second.
        seconds = ((words / F.lit(200.0)) * F.lit(60.0)).cast("int")
        some = words > 0
        return F.struct(
            words.alias("words_count"),
            F.when(some, F.greatest(v["sentences"], F.lit(1))).otherwise(F.lit(0)).alias("sentences_count"),
            F.when(some, round_exact(v["letters"] / words, 1)).otherwise(F.lit(0.0)).alias("avg_word_length"),
            F.when(some, F.greatest(seconds, F.lit(1))).otherwise(F.lit(0)).alias("estimated_reading_time_seconds"),
        )

    def from_joined(v: Column) -> Column:
        counts = F.struct(
            v["words"].alias("words"),
            F.length(v["joined"]).alias("letters"),
            _filled(F.split(v["joined"], f"[{SENTENCE_ENDS}]+")).alias("sentences"),
        )
        return _let(counts, from_counts)

    def from_plain(text: Column) -> Column:
        parts = F.struct(
            _filled(F.split(text, " ")).alias("words"), F.replace(text, F.lit(" "), F.lit("")).alias("joined")
        )
        return _let(parts, from_joined)

    return _let(plain, from_plain)


def analyze_readability(c: Column | str) -> Column:
    return readability_from_text(plain_spaces(text_or_empty(c)))


def topic_candidates(words: Column, stop_words: Sequence[str]) -> Column:
    stop = list(stop_words)
    return F.filter(
        words,
        # A word that begins with a plain letter is no number and needs no pattern.
        lambda w: (F.length(w) > 2) & ~w.isin(stop) & (w.between("a", "{") | ~F.rlike(w, F.lit(r"\A\p{Nd}+\z"))),
    )


def top_terms(candidates: Column, limit: int = 5) -> Column:
    """The ``limit`` most frequent entries, ties by first occurrence.

    Sorting brings equal terms together, so a term's count is the distance between two
    run ends. Only the terms above the count of the last place are looked up for their
    position; those at that count come in text order from one intersection. Everything
    happens inside the row, n log n, where exploding would shuffle every word.
    """

    def from_terms(terms: Column) -> Column:
        return _let(
            F.struct(terms.alias("terms"), F.sort_array(terms).alias("sorted")),
            lambda v: F.when(F.size(v["terms"]) == 0, F.array().cast("array<string>")).otherwise(from_sorted(v)),
        )

    def from_sorted(v: Column) -> Column:
        ends = F.array_compact(
            F.transform(v["sorted"], lambda term, i: F.when(~term.eqNullSafe(F.get(v["sorted"], i + 1)), i + 1))
        )
        return _let(
            F.struct(v["terms"].alias("terms"), v["sorted"].alias("sorted"), ends.alias("ends")), from_ends
        )

    def from_ends(v: Column) -> Column:
        runs = F.transform(
            v["ends"],
            lambda end, i: F.struct((end - F.coalesce(F.get(v["ends"], i - 1), F.lit(0))).alias("n"), end.alias("end")),
        )
        return _let(F.struct(v["terms"].alias("terms"), v["sorted"].alias("sorted"), runs.alias("runs")), from_runs)

    def from_runs(v: Column) -> Column:
        counts = F.sort_array(v["runs"]["n"], asc=False)
        last = F.get(counts, F.least(F.size(counts), F.lit(limit)) - 1)
        cut = F.struct(v["terms"].alias("terms"), v["sorted"].alias("sorted"), v["runs"].alias("runs"), last.alias("last"))
        return _let(cut, from_cut)

    def from_cut(v: Column) -> Column:
        named = lambda r: F.get(v["sorted"], r["end"] - 1)
        above = F.filter(v["runs"], lambda r: r["n"] > v["last"])
        level = F.transform(F.filter(v["runs"], lambda r: r["n"] == v["last"]), named)
        placed = F.transform(
            above, lambda r: F.struct((-r["n"]).alias("n"), F.array_position(v["terms"], named(r)).alias("pos"), named(r).alias("term"))
        )
        head = F.transform(F.sort_array(placed), lambda r: r["term"])
        tail = F.slice(F.array_intersect(v["terms"], level), F.lit(1), F.lit(limit) - F.size(head))
        return F.concat(head, tail)

    return _let(candidates, from_terms)


def extract_topics(
    c: Column | str,
    lang: Column | str | None = None,
    limit: int = 5,
    words: Column | None = None,
    english: Sequence[str] = lex.ENGLISH_STOP_WORDS,
    persian: Sequence[str] = lex.PERSIAN_STOP_WORDS,
) -> Column:
    words = tokens(text_or_empty(c)) if words is None else words
    if lang is None:
        return top_terms(topic_candidates(words, english), limit)
    kept = F.when(_col(lang) == "fa", topic_candidates(words, persian)).otherwise(topic_candidates(words, english))
    return top_terms(kept, limit)


def matched_triggers(c: Column | str, weights: Mapping[str, float] = lex.URGENCY_WEIGHTS) -> Column:
    def find(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in weights]))

    return _let(F.lower(text_or_empty(c)), find)


def urgency_score(triggers: Column, weights: Mapping[str, float] = lex.URGENCY_WEIGHTS) -> Column:
    """Sum of the matched weights in the order of the list, capped."""
    total = F.lit(0.0)
    for word, weight in weights.items():
        total = total + F.when(F.array_contains(triggers, word), F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.least(total, F.lit(0.5))


def capped_rating(base: float, urgency: Column, impact: Column) -> Column:
    return round_exact(F.least(F.lit(base) + urgency + impact, F.lit(1.0)), 2)


def signals_from_parts(triggers: Column, urgency: Column, impact: Column, priority: Column, blank: Column) -> Column:
    """The route follows the rounded priority; blank text gets zeros and no confidence."""
    confidence = round_exact(F.lit(0.5) + urgency * F.lit(0.5) + impact * F.lit(0.5), 2)
    route = (
        F.when(blank, F.lit("standard_processing"))
        .when(priority >= 0.7, F.lit("publish_immediately"))
        .when(priority >= 0.4, F.lit("review_required"))
        .otherwise(F.lit("standard_processing"))
    )
    return F.struct(
        F.when(blank, F.lit(0.0)).otherwise(priority).alias("priority"),
        F.when(blank, F.lit(0.0)).otherwise(capped_rating(0.3, urgency, impact)).alias("relevance_score"),
        route.alias("dispatch_route"),
        F.when(~blank, confidence).alias("confidence"),
        triggers.alias("matched_triggers"),
    )


def sentiment_impact(score: Column) -> Column:
    return F.abs(score) * F.lit(0.2)


def agent_signals(
    c: Column | str, score: Column, weights: Mapping[str, float] = lex.URGENCY_WEIGHTS
) -> Column:
    """Signals as one expression; ``operators.analysis`` computes the same in steps."""
    text = text_or_empty(c)
    found = F.struct(
        matched_triggers(text, weights).alias("triggers"), sentiment_impact(score).alias("impact"), (text == "").alias("blank")
    )

    def from_found(v: Column) -> Column:
        urgency = urgency_score(v["triggers"], weights)
        return _let(F.struct(v["triggers"].alias("triggers"), v["impact"].alias("impact"), v["blank"].alias("blank"), urgency.alias("urgency")), from_urgency)

    def from_urgency(v: Column) -> Column:
        priority = capped_rating(0.2, v["urgency"], v["impact"])
        return _let(priority, lambda p: signals_from_parts(v["triggers"], v["urgency"], v["impact"], p, v["blank"]))

    return _let(found, from_found)
