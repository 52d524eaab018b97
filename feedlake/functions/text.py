"""Text cleaning, templates and tags as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from feedlake.functions.lexicons import TAG_KEYWORDS

# Character classes. Java's \s and \w differ from the definitions the results are
# specified with, so they are spelled out.
LINE_BREAKS = "\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
OTHER_INLINE_SPACES = "\t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
INLINE_SPACES = " " + OTHER_INLINE_SPACES
NON_WORD = r"[^\p{L}\p{N}_]"
# Ranges are tested before the classes and answer for most characters.
WORD = r"[a-z0-9_\p{L}\p{N}]"
MARKUP = "<[^>]+>"
ALL_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# Whitespace but the space. Of characters past Latin-1 only those between the first and the last
# wide space are looked up one by one, so others cost one comparison.
_NARROW = "".join(c for c in ALL_SPACES if c < "\u0100" and c != " ")
_WIDE = "".join(c for c in ALL_SPACES if c >= "\u0100")
OTHER_SPACES = f"[{_NARROW}[{_WIDE[0]}-{_WIDE[-1]}&&[{_WIDE}]]]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def is_filled(c: Column) -> Column:
    """True for text that is neither null nor empty; never null."""
    return F.coalesce(c != "", F.lit(False))


def plain_spaces(c: Column | str) -> Column:
    """Every whitespace character as a space."""
    return F.regexp_replace(_col(c), OTHER_SPACES, " ")


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(c), "  +", " "))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace, inside untouched."""
    return F.btrim(_col(c), F.lit(ALL_SPACES))


def normalize_title(c: Column | str) -> Column:
    return F.coalesce(normalize_whitespace(F.lower(_col(c))), F.lit(""))


def strip_markup(c: Column | str) -> Column:
    """Delete tags, inserting nothing.

    Only the text up to the last ``>`` can hold a tag; leaving the tail out keeps the
    scan linear on text with many unclosed ``<``.
    """
    c = _col(c)
    tail = F.substring_index(c, ">", -1)
    head = F.left(c, F.length(c) - F.length(tail))
    return F.concat(F.regexp_replace(head, MARKUP, ""), tail)


def sanitize_title(c: Column | str) -> Column:
    return normalize_whitespace(strip_markup(c))


def sanitize_content(c: Column | str) -> Column:
    """One clean line per non-blank line.

    Inline runs collapse first, so the second pattern sees at most one space before a
    break and needs no backtracking. A single space stays and is no match: most are.
    """
    inline = F.regexp_replace(strip_markup(c), f" [{INLINE_SPACES}]+|[{OTHER_INLINE_SPACES}][{INLINE_SPACES}]*", " ")
    lines = F.regexp_replace(inline, f" ?[{LINE_BREAKS}][{LINE_BREAKS} ]*", "\n")
    return F.btrim(lines, F.lit(" \n"))


def tokens(c: Column | str) -> Column:
    """Lower-cased words in order; one pass, no lambda."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"{WORD}+"), 0)


def lexicon_tokens(c: Column | str) -> Column:
    """Words split before lower-casing.

    The dotted capital I is the one letter whose lower case holds a non-word character;
    it is replaced by a letter no word list contains, so it cannot split a word.
    """
    return tokens(F.replace(_col(c), F.lit("İ"), F.lit("ı")))


def render_template(template: str, columns: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` slots of ``template`` from columns; null fills as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(text_or_empty(columns[name]))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def prompt_template(prompts: Mapping[str, str], name: str, columns: Mapping[str, Column | str]) -> Column:
    """Template looked up by name; an unknown name gives empty text."""
    return render_template(prompts.get(name, ""), columns)


PROMPT = "Title: {title}\nContent: {content}"


def prompt(title: Column | str, content: Column | str) -> Column:
    return render_template(PROMPT, {"title": title, "content": content})


def tag_keywords(
    title: Column | str,
    content: Column | str,
    keywords: Mapping[str, Sequence[str]] = TAG_KEYWORDS,
) -> Column:
    """Tags with at least one keyword occurring anywhere in the lower-cased text."""
    if not keywords:
        return F.array().cast("array<string>")

    def find(text: Column) -> Column:
        flags = []
        for tag, words in keywords.items():
            found = F.lit(False)
            for word in words:
                found = found | F.contains(text, F.lit(word))
            flags.append(F.when(found, F.lit(tag)))
        return F.array_compact(F.array(*flags))

    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(content)))
    return F.get(F.transform(F.array(text), find), F.lit(0))


def append_tags(rewritten: Column | str, tags: Column | str) -> Column:
    rewritten, tags = _col(rewritten), _col(tags)
    line = F.concat(F.lit("\n\nTags: #"), F.array_join(tags, " #"))
    return F.when((F.size(tags) > 0) & is_filled(rewritten), F.concat(rewritten, line)).otherwise(rewritten)


FALLBACK_MARK = "[Rewritten Failed - Fallback]: "


def rewrite_or_fallback(text: Column | str, content: Column | str) -> Column:
    """Provider text, or the marked original where the provider gave none."""
    return F.coalesce(_col(text), F.concat(F.lit(FALLBACK_MARK), text_or_empty(content)))
