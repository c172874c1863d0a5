"""Prompt context: section dedupe, history selection, overlap, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan import constants as K
from quillspan.functions import policy as P, text as T

OVERLAP_GRAM = 120
CONTAIN_MIN = 80


def _joined(order: str, value: Column, separator: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda r: r["v"]),
        separator)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, paragraph, dedup_key): non-blank paragraphs of the sanitised section."""
    parts = F.split(T.sanitize_section(F.col(text)), r"\n\s*\n")
    return (
        docs.select(key, F.posexplode(parts).alias("pos", "raw"))
        .withColumn("paragraph", T.trimmed(F.col("raw"))).filter("paragraph != ''").drop("raw")
        .withColumn("dedup_key", T.dedup_key(F.col("paragraph")))
    )


def dedupe_paragraphs(docs: DataFrame, keep: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, paragraph): at most ``keep`` occurrences of a paragraph key, in order."""
    order = Window.partitionBy(key, "dedup_key").orderBy("pos")
    return (
        paragraphs(docs, key, text).withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= max(1, keep)).select(key, "pos", "paragraph")
    )


def deduplicated_sections(docs: DataFrame, keep: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section): the kept paragraphs joined again; documents left empty give ''."""
    joined = dedupe_paragraphs(docs, keep, key, text).groupBy(key).agg(
        _joined("pos", F.col("paragraph"), "\n\n").alias("section"))
    return docs.select(key).join(joined, key, "left").withColumn("section", F.coalesce("section", F.lit("")))


def retry_sections(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section): each section with every paragraph once, then its head and tail within ``limit`` characters."""
    return deduplicated_sections(docs, 1, key, text).withColumn("section", T.compact_for_retry(F.col("section"), limit))


def overlapping_history(history: DataFrame, prompts: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, turn): history messages that substantially repeat their request's prompt.

    Equal keys, containment of a key of 80 or more characters, or a common substring
    of 120 characters.  Keys are at most 240 characters, so the 120-character
    windows of a key are at most 121 rows; matching windows is an equi semi-join.
    """
    h = history.select(request, "turn", T.dedup_key(T.sanitize_section(F.col("text"))).alias("h_key"))
    p = prompts.select(request, T.dedup_key(T.sanitize_section(F.col("prompt"))).alias("p_key"))
    both = h.join(p, request).filter((F.col("h_key") != "") & (F.col("p_key") != ""))
    shorter = F.least(F.length("h_key"), F.length("p_key"))
    direct = (F.col("h_key") == F.col("p_key")) | (
        (shorter >= CONTAIN_MIN) & (F.contains("h_key", F.col("p_key")) | F.contains("p_key", F.col("h_key"))))

    def grams(c: str) -> Column:
        n = F.length(c) - (OVERLAP_GRAM - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                         lambda i: F.substring(F.col(c), i, F.lit(OVERLAP_GRAM)))).otherwise(
            F.array().cast("array<string>"))

    shared = F.arrays_overlap(grams("h_key"), grams("p_key"))
    return both.filter(direct | F.coalesce(shared, F.lit(False))).select(request, "turn").distinct()


def select_history(history: DataFrame, prompts: DataFrame, budget: int = K.HISTORY_BUDGET,
                   turns: int = K.MAX_HISTORY_TURNS, request: str = "request_id") -> DataFrame:
    """(request, turn, line): newest messages that fit the budget, at least one, unique keys.

    The first message that would overflow ends the selection.
    """
    newest = Window.partitionBy(request).orderBy(F.desc("turn"))
    recent = history.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= turns)
    clean = T.simplified(T.sanitize_section(F.col("text")))
    recent = recent.withColumn("clean", clean).withColumn("h_key", T.dedup_key(F.col("clean"))).filter("h_key != ''")
    usable = recent.join(overlapping_history(recent, prompts, request), [request, "turn"], "left_anti")
    once = Window.partitionBy(request, "h_key").orderBy(F.desc("turn"))
    lines = (
        usable.withColumn("n", F.row_number().over(once)).filter("n = 1")
        .withColumn("line", F.concat(F.upper("role"), F.lit(": "), F.col("clean")))
        .withColumn("cost", F.length("line") + 2)
        .withColumn("used", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("first", F.row_number().over(newest) == 1)
        .withColumn("over", F.max((~F.col("first") & (F.col("used") > budget)).cast("int")).over(
            newest.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return lines.filter("over = 0").select(request, "turn", "line")


def history_context(selected: DataFrame, request: str = "request_id") -> DataFrame:
    return selected.groupBy(request).agg(_joined("turn", F.col("line"), "\n\n").alias("history"))


def assemble_context(requests: DataFrame, history: DataFrame, request: str = "request_id",
                     first_pass: bool = False) -> DataFrame:
    """(request, developer, user): context sections in order, each within its budget.

    requests: request, prompt, local_context, external_context, memory_context,
    summary, outline.  history: request, history.
    """
    rows = requests.join(history, request, "left").withColumn("history", F.coalesce("history", F.lit("")))
    for column in ("local_context", "external_context", "memory_context", "summary"):
        section = deduplicated_sections(requests.select(request, column), 1, request, column)
        rows = rows.join(section.withColumnRenamed("section", f"{column}_clean"), request)
    transform = P.transform_prompt(F.col("prompt"))
    rows = rows.withColumn("transform", transform)
    active = F.col("transform.active")
    local_budget = K.LOCAL_BUDGET_FIRST_PASS if first_pass else K.LOCAL_BUDGET
    external_budget = K.EXTERNAL_BUDGET_FIRST_PASS if first_pass else K.EXTERNAL_BUDGET

    def section(title: str, body: Column, keep: Column | None = None) -> Column:
        test = ~T.is_blank(body) if keep is None else keep & ~T.is_blank(body)
        return F.when(test, F.concat(F.lit(title + ":\n"), body))

    summary = T.trim_for_budget(F.col("summary_clean"), K.SUMMARY_BUDGET)
    developer = F.concat_ws(
        "\n\n",
        section("RELEVANT_MEMORIES", T.trim_for_budget(F.col("memory_context_clean"), K.MEMORY_BUDGET)),
        section("SESSION_SUMMARY", summary, ~active),
        section("DOCUMENT_OUTLINE_PLAN", T.trim_for_budget(T.sanitize_section(F.col("outline")), K.OUTLINE_BUDGET)),
    )
    user = F.concat_ws(
        "\n\n",
        section("LOCAL_CONTEXT", T.trim_for_budget(F.col("local_context_clean"), local_budget)),
        section("EXTERNAL_CONTEXT", T.trim_for_budget(F.col("external_context_clean"), external_budget)),
        section("RECENT_CONVERSATION", F.col("history"), ~active),
        F.when(active, F.concat(F.lit("TASK_INSTRUCTION:\n"), T.sanitize_section(F.col("transform.instruction")))),
        F.when(active, F.concat(F.lit("SOURCE_MATERIAL:\n"), T.trim_for_budget(
            T.sanitize_section(F.col("transform.source")), 14000))),
        F.when(~active, F.concat(F.lit("USER_REQUEST:\n"), T.sanitize_section(F.col("prompt")))),
    )
    return rows.select(request, developer.alias("developer"), user.alias("user"))
