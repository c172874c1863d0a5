"""Names, labels, paths and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspan import constants as K
from quillspan.functions import text as T


def suffix(name: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty when there is no dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def source_type(name: Column) -> Column:
    ext = suffix(name)
    out = F.when(ext.isin(*K.SUFFIX_TYPES["log"]), "log")
    for kind in ("config", "doc", "code"):
        out = out.when(ext.isin(*K.SUFFIX_TYPES[kind]), kind)
    return out.otherwise("misc")


def source_role(name: Column, path: Column, kind: Column, text: Column) -> Column:
    probe = F.lower(F.concat(name, F.lit(" "), path, F.lit(" "), F.left(text, F.lit(K.ROLE_HEAD_CHARS))))
    return (
        F.when((kind == "log") | T.any_contains(probe, K.ROLE_LOG_WORDS), "log")
        .when(kind == "config", "config")
        .when(kind == "code", "code")
        .when(T.any_contains(probe, K.ROLE_SCENARIO_WORDS), "scenario")
        .when(T.any_contains(probe, K.ROLE_PROCEDURE_WORDS), "procedure")
        .when(T.any_contains(probe, K.ROLE_REFERENCE_WORDS), "reference")
        .when(kind == "doc", "reference")
        .otherwise(kind)
    )


def conversation_title(c: Column) -> Column:
    words = F.split(T.simplified(c), " ")
    title = F.array_join(F.slice(words, 1, 8), " ")
    return (
        F.when(T.simplified(c) == "", "New conversation")
        .when(F.size(words) > 8, F.concat(title, F.lit("...")))
        .otherwise(title)
    )


def sanitize_label(c: Column) -> Column:
    c = F.regexp_replace(T.trimmed(c), "[^A-Za-z0-9._-]+", "_")
    c = F.regexp_replace(F.regexp_replace(c, "_{2,}", "_"), r"^[_.]+|[_.]+\z", "")
    return F.when(c == "", "item").otherwise(c)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.regexp_replace(path, r"(?:^|/)[^/]*\z", "")


def group_label(relative_path: Column) -> Column:
    folder = parent_path(relative_path)
    return F.when(T.trimmed(folder).isin("", "."), "(root)").otherwise(folder)


def group_id(collection_id: Column, label: Column) -> Column:
    return F.sha1(F.encode(F.concat(collection_id, F.lit("|"), label), "UTF-8"))


def standalone_path(absolute_path: Column) -> Column:
    parent = parent_path(absolute_path)
    return F.concat(
        sanitize_label(F.substring_index(parent, "/", -1)), F.lit("_"),
        F.left(F.sha1(F.encode(parent, "UTF-8")), F.lit(10)), F.lit("/"),
        F.substring_index(absolute_path, "/", -1),
    )


def path_inside_root(path: Column, root: Column) -> Column:
    return (path != "") & (root != "") & ((path == root) | F.startswith(path, F.concat(root, F.lit("/"))))


def split_paths(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[;,\n]"), T.trimmed), lambda p: p != "")


def format_bytes(n: Column) -> Column:
    """B to TB; one decimal below ten units."""
    value = F.greatest(n, F.lit(0)).cast("double")
    out = F.when(value < 1024, F.format_string("%.0f B", value))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scaled = value / float(1024 ** power)
        shown = F.when(scaled >= 10, F.format_string(f"%.0f {unit}", F.bround(scaled, 0))).otherwise(
            F.format_string(f"%.1f {unit}", F.bround(scaled, 1)))
        out = out.otherwise(shown) if unit == "TB" else out.when(scaled < 1024, shown)
    return out


def memory_key(c: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.left(F.when(key == "", "memory-note").otherwise(key), F.lit(64))


def memory_value(c: Column) -> Column:
    c = F.regexp_replace(c, "^[\"'`\\t-\\r ]+|[\"'`\\t-\\r ]+\\z", "")
    c = T.trimmed(F.regexp_replace(c, r"[\t-\r ]+", " "))
    c = F.when((c == "") | c.rlike(r"[.!?]\z"), c).otherwise(F.concat(c, F.lit(".")))
    return T.compact(c, 220)


def prompt_safe_value(c: Column) -> Column:
    """May a memory value be quoted in a prompt."""
    text = T.trimmed(c)
    lower = F.lower(text)
    brackets = F.length(lower) - F.length(F.translate(lower, "{}[]<>", ""))
    term_count = F.regexp_count(lower, F.lit("[a-z0-9]+"))
    return (
        F.length(text).between(3, 220) & ~text.contains("\n") & ~text.contains("```")
        & ~text.endswith("?") & ~T.any_contains(lower, K.UNSAFE_PHRASES)
        & (brackets < 4) & (term_count <= 32)
    )


def prompt_safe_memory(value: Column, query: Column) -> Column:
    q, v = memory_key(query), memory_key(value)
    return prompt_safe_value(value) & ~F.contains(q, v) & ~F.contains(v, q)


def memory_line(category: Column, key: Column, value: Column) -> Column:
    shown = F.when(key == "", "note").otherwise(key)
    return F.concat(F.lit("["), category, F.lit("] "), shown, F.lit(" = "), value)


def memory_description(category: Column, key: Column, value: Column) -> Column:
    kind = F.when(T.is_blank(category), "general").otherwise(T.trimmed(category))
    preview = T.compact(value, 96)
    return F.concat(
        F.lit("Stored as a "), kind, F.lit(" memory"),
        F.when(T.is_blank(key), "").otherwise(F.concat(F.lit(" under key '"), T.trimmed(key), F.lit("'"))),
        F.lit(" for reuse when later prompts match this topic."),
        F.when(preview == "", "").otherwise(F.concat(F.lit(" Value preview: "), preview)),
    )


def zero_chunk_reason(
    ok: Column, extractor: Column, chars: Column, words: Column, blocks: Column,
    candidates: Column, filtered: Column, duplicates: Column,
) -> Column:
    """Reason label of a file that yields no chunk."""
    tool = F.lower(T.trimmed(extractor))
    fallback = (
        F.when(tool == "canceled", "canceled")
        .when(tool == "binary-skipped", "binary-or-unsupported")
        .when(tool == "read-failed", "unreadable")
        .when(tool == "pdf:load-failed", "pdf-extraction-failed")
        .when(tool.startswith("pdf:") & (chars <= 0), "pdf-no-text")
        .when(tool == "docx:load-failed", "docx-extraction-failed")
        .when(tool.startswith("docx:") & (chars <= 0), "docx-no-text")
        .when((chars <= 0) | (words <= 0), "no-usable-text")
        .otherwise("nothing-survived")
    )
    gone = filtered + duplicates >= candidates
    return (
        F.when(~ok | (chars <= 0), fallback)
        .when(blocks <= 0, "no-blocks")
        .when(candidates <= 0, "no-candidates")
        .when(gone & (filtered > 0) & (duplicates > 0), "all-filtered-or-duplicate")
        .when(gone & (filtered > 0), "all-filtered")
        .when(gone & (duplicates > 0), "all-duplicate")
        .otherwise(fallback)
    )
