"""Redaction, prompt classification and web snippet policy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspan import constants as K
from quillspan.functions import terms, text as T


def redact(c: Column) -> Column:
    for pattern in K.REDACTION_PATTERNS:
        c = F.regexp_replace(c, pattern, K.REDACTION_TEXT)
    return F.trim(F.regexp_replace(c, r"[\t-\r ]+", " "))


def looks_sensitive(c: Column) -> Column:
    """Redaction changed more than white space."""
    return redact(c) != F.trim(F.regexp_replace(c, r"[\t-\r ]+", " "))


def search_query(c: Column, cap: int = 12) -> Column:
    return F.array_join(F.slice(terms.keywords(F.lower(redact(c))), 1, cap), " ")


def wants_external_search(c: Column) -> Column:
    lower = T.trimmed(F.lower(c))
    local = T.any_contains(lower, K.LOCAL_SIGNALS)
    public = T.any_contains(lower, K.PUBLIC_SIGNALS) | lower.rlike(K.RE_IDENTITY_QUESTION)
    return (lower != "") & (lower.rlike(K.RE_EXPLICIT_SEARCH) | (public & ~local))


def is_structured_document(c: Column) -> Column:
    return T.any_contains(F.lower(c), K.STRUCTURED_DOC_WORDS)


def is_exact_extraction(c: Column) -> Column:
    lower = F.lower(c)
    return (T.any_contains(lower, K.EXTRACTION_VERBS) & T.any_contains(lower, K.EXTRACTION_TARGETS)) | (
        T.any_contains(lower, K.EXTRACTION_PHRASES)
    )


def is_document_study(c: Column) -> Column:
    return is_exact_extraction(c) | T.any_contains(F.lower(c), K.STUDY_WORDS)


def is_casual(c: Column) -> Column:
    return F.lower(T.trimmed(c)).isin(*K.CASUAL_PROMPTS)


def needs_grounding(c: Column) -> Column:
    return ~is_casual(c) & (T.any_contains(F.lower(c), K.GROUNDING_SIGNALS) | is_structured_document(c))


def prompt_flags(c: Column) -> Column:
    return F.struct(
        is_structured_document(c).alias("structured_document"),
        is_exact_extraction(c).alias("exact_extraction"),
        is_document_study(c).alias("document_study"),
        is_casual(c).alias("casual"),
        needs_grounding(c).alias("needs_grounding"),
    )


def document_type(c: Column) -> Column:
    """MOP, Runbook or Guide for document prompts; null otherwise."""
    lower = F.lower(c)
    return (
        F.when(~T.any_contains(lower, K.DOC_WORDS), F.lit(None))
        .when(T.any_contains(lower, ["mop", "method of procedure"]), "MOP")
        .when(T.any_contains(lower, ["runbook", "playbook"]), "Runbook")
        .otherwise("Guide")
    )


def planner_intent(c: Column) -> Column:
    lower = F.lower(c)
    kind = document_type(c)
    return (
        F.when(kind.isin("MOP", "Runbook"), "document_generation")
        .when((kind == "Guide") & T.any_contains(lower, K.ARCHITECTURE_WORDS), "architecture")
        .when(kind == "Guide", "document_generation")
        .when(T.any_contains(lower, K.TROUBLE_WORDS), "troubleshooting")
        .when(T.any_contains(lower, K.ARCHITECTURE_WORDS), "architecture")
        .when(T.any_contains(lower, K.IMPLEMENTATION_WORDS), "implementation")
        .otherwise("general")
    )


def inline_intent(c: Column) -> Column:
    lower = F.lower(c)
    return (
        F.when(T.any_contains(lower, K.INLINE_TROUBLE_WORDS), "troubleshooting")
        .when(is_document_study(c), "document_generation")
        .when(T.any_contains(lower, K.INLINE_ARCHITECTURE_WORDS), "architecture")
        .when(T.any_contains(lower, K.INLINE_IMPLEMENTATION_WORDS), "implementation")
        .otherwise("general")
    )


def transform_prompt(c: Column) -> Column:
    """Instruction block and dominating source text of a pasted-material prompt."""
    text = T.trimmed(c)
    parts = F.split(text, r"\n\s*\n", 2)
    first = T.trimmed(parts[0])
    rest = T.trimmed(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    lower = F.lower(first)
    active = (
        (F.length(text) >= 500) & (F.size(parts) == 2) & (first != "") & (F.length(rest) >= 350)
        & (F.length(first) <= 600) & (F.length(rest) >= F.greatest(F.lit(450), F.length(first) * 2))
        & (T.any_contains(lower, K.TRANSFORM_VERBS) | T.any_contains(lower, K.TRANSFORM_CUES))
    )
    return F.struct(
        active.alias("active"),
        F.when(active, first).otherwise("").alias("instruction"),
        F.when(active, rest).otherwise("").alias("source"),
    )


def privacy_preview(c: Column, allowed: Column, recommended: Column, sanitized: Column) -> Column:
    def yes_no(b: Column) -> Column:
        return F.when(b, "yes").otherwise("no")

    return F.concat(
        F.lit("Original prompt:\n"), c,
        F.lit("\nSensitive input detected: "), yes_no(looks_sensitive(c)),
        F.lit("External search allowed in UI: "), yes_no(allowed),
        F.lit("External search recommended by policy: "), yes_no(recommended),
        F.lit("\nSanitized external query:\n"),
        F.when(sanitized == "", "<empty>").otherwise(sanitized),
    )


def html_snippet(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, plain in K.HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    c = F.regexp_replace(c, "[\t\r\n]+", " ")
    for marker in K.ENVELOPE_MARKERS:
        c = F.replace(c, F.lit(marker), F.lit(K.ENVELOPE_REPLACEMENT))
    return T.simplified(c)


def url_host(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit(""))


def failure_class(c: Column) -> Column:
    lower = F.lower(c)
    return (
        F.when(T.any_contains(lower, K.PERMANENT_FAILURES), "permanent")
        .when(T.any_contains(lower, K.CONTEXT_FAILURES), "context-length")
        .when(T.any_contains(lower, K.RUNNER_FAILURES), "runner-crash")
        .otherwise("other")
    )


def is_verbose_diagnostic(category: Column, message: Column) -> Column:
    lower = F.lower(T.trimmed(message))
    hit = F.lit(False)
    for prefix in K.VERBOSE_PREFIXES:
        hit = hit | lower.startswith(prefix)
    return (F.lower(T.trimmed(category)) != "reasoning") & hit
