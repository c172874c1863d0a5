"""Line and chunk shape predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspan import constants as K
from quillspan.functions import text as T


def is_page_marker(line: Column) -> Column:
    return line.startswith("[[PAGE ") & line.endswith("]]")


def is_fence(line: Column) -> Column:
    return line.startswith("```") | line.startswith("~~~")


def is_heading(line: Column) -> Column:
    """``line`` is already trimmed."""
    return line.startswith("#") | line.rlike(K.RE_NUMBERED_HEADING) | line.rlike(K.RE_TITLED_HEADING)


def is_bullet(line: Column) -> Column:
    return line.rlike(K.RE_BULLET)


def is_code_like(raw: Column) -> Column:
    line = T.trimmed(raw)
    return (line != "") & (
        raw.startswith("    ") | raw.startswith("\t") | line.startswith("$") | line.startswith("#")
        | T.any_contains(line, ["::", "=>", "{", "}", "="])
    )


def is_procedural_lead(line: Column) -> Column:
    return (line != "") & ~is_page_marker(line) & (
        line.rlike(K.RE_LEAD_NUMBERED) | line.rlike(K.RE_LEAD_IMPERATIVE) | line.rlike(K.RE_LEAD_STEP)
    )


def looks_like_contents_entry(line: Column) -> Column:
    # both patterns end in a digit, and few lines do
    return (line != "") & (F.length(line) <= 220) & ~is_page_marker(line) & F.right(line, F.lit(1)).between("0", "9") & (
        line.rlike(K.RE_DOTTED_LEADER) | line.rlike(K.RE_TRAILING_PAGE)
    )


def normalize_outline_key(c: Column) -> Column:
    return F.lower(T.simplified(F.regexp_replace(T.trimmed(c), r"\.{2,}\s*\d+\z", "")))


def strip_trailing_page_number(c: Column) -> Column:
    c = F.regexp_replace(T.trimmed(c), r"\.{2,}\s*\d+\z", "")
    return T.trimmed(F.regexp_replace(c, r"\s+\d+\z", ""))


def is_top_level_heading(line: Column) -> Column:
    return line.rlike(K.RE_TOP_HEADING)


def is_top_level_number(line: Column) -> Column:
    return line.rlike(K.RE_TOP_NUMBER)


def is_number_only(line: Column) -> Column:
    return line.rlike(K.RE_NUMBER_ONLY)


def is_reserved_outline_word(line: Column) -> Column:
    return F.lower(line).isin(*K.OUTLINE_RESERVED)


def heading_body_key(c: Column) -> Column:
    c = F.regexp_replace(strip_trailing_page_number(c), r"^\d+(?:\.\d+){0,4}[.)]?\s*", "")
    c = F.regexp_replace(c, r"^[A-Z][.)]\s*", "")
    return F.lower(T.simplified(c))


def keep_chunk(c: Column) -> Column:
    """Is a chunk text strong enough to index."""
    simple = T.simplified(c)
    alnum, words = T.alnum_count(simple), T.count_words(simple)
    structured = c.contains("\n") & T.any_contains(c, ["{", "=", ":", "->"])
    enough = F.when(structured, (alnum >= 18) & (words >= 3)).otherwise((alnum >= 32) & (words >= 6))
    return (simple != "") & ((F.length(simple) >= 80) | enough)


def actionability(c: Column) -> Column:
    def of(text: Column, lower: Column) -> Column:
        score = F.when(text.contains("```"), 6).otherwise(0)
        score = score + F.when(text.rlike("(?d)" + K.RE_COMMAND_LINE), 7).otherwise(0)
        for points, words in K.ACTION_WORDS:
            score = score + F.when(T.any_contains(lower, words), points).otherwise(0)
        score = score + F.when(text.rlike("(?d)" + K.RE_BULLET_LINE), 2).otherwise(0)
        score = score + F.when(text.rlike("(?d)" + K.RE_NUMBERED_LINE), 3).otherwise(0)
        score = score + F.when(text.rlike("(?d)" + K.RE_KEY_VALUE_LINE), 2).otherwise(0)
        return score + F.when(T.any_contains(text, ["{", "=", "->"]), 1).otherwise(0)

    # the text is cleaned once, also where the score is a filter
    return T.let(T.normalize_block(c), lambda text: T.let(F.lower(text), lambda lower: of(text, lower)))


def looks_like_structure(c: Column) -> Column:
    headings = F.size(F.filter(F.split(c, "\n"), lambda line: is_heading(T.trimmed(line))))
    pairs = F.regexp_count(c, F.lit(K.RE_SPLIT_HEADING_PAIR))
    return T.any_contains(F.lower(c), K.STRUCTURE_WORDS) | (headings >= 3) | (pairs >= 2)
