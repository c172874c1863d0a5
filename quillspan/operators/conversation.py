"""Conversation tables: index, edits, transcript, summary, code blocks, export."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan import constants as K
from quillspan.functions import labels as LB, text as T
from quillspan.operators.positions import number_rows

CONV = "conv_id"


def _joined(order: str, value: Column, separator: str) -> Column:
    """Ordered string concatenation as an aggregate."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda r: r["v"]),
        separator)


def conversation_index(messages: DataFrame) -> DataFrame:
    """(conv_id, title, created_at, updated_at, messages): one row per conversation.

    The title comes from the first user message.
    """
    user = F.when(F.col("role") == "user", F.col("text"))
    return messages.groupBy(CONV).agg(
        F.min_by(user, F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.count(F.lit(1)).alias("messages"),
    ).select(CONV, LB.conversation_title(F.coalesce("first_user", F.lit(""))).alias("title"),
             "created_at", "updated_at", "messages")


def append_messages(messages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append, numbering new turns after the last stored one; unknown conversations are ignored."""
    last = messages.groupBy(CONV).agg(F.max("turn").alias("last_turn"))
    order = Window.partitionBy(CONV).orderBy("created_at", "seq")
    added = incoming.join(last, CONV).withColumn(
        "turn", F.col("last_turn") + F.row_number().over(order)).drop("last_turn", "seq")
    return messages.unionByName(added)


def rename_conversations(index: DataFrame, names: DataFrame, now: str) -> DataFrame:
    """New titles by conversation; a blank title only moves updated_at."""
    change = names.select(CONV, T.trimmed(F.col("title")).alias("new_title"))
    hit = F.col("new_title").isNotNull()
    return (
        index.join(change, CONV, "left")
        .withColumn("title", F.when(hit & (F.col("new_title") != ""), F.col("new_title")).otherwise(F.col("title")))
        .withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))).drop("new_title")
    )


def update_summaries(index: DataFrame, summaries: DataFrame, now: str) -> DataFrame:
    hit = F.col("new_summary").isNotNull()
    base = index if "summary" in index.columns else index.withColumn("summary", F.lit(""))
    return (
        base.join(summaries.select(CONV, F.col("summary").alias("new_summary")), CONV, "left")
        .withColumn("summary", F.coalesce("new_summary", "summary"))
        .withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))).drop("new_summary")
    )


def delete_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(CONV).distinct(), CONV, "left_anti")


def order_conversations(index: DataFrame) -> DataFrame:
    """``index`` with ``place``, from 0: the latest first."""
    return number_rows(index, [], [F.desc("updated_at"), F.col(CONV)])


def recent_messages(messages: DataFrame, n: int = K.MAX_HISTORY_TURNS) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    order = Window.partitionBy(CONV).orderBy(F.desc("turn"))
    return messages.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n)


def _mark_refused(messages: DataFrame) -> DataFrame:
    """Adds ``open``: a user question whose next message is an assistant refusal.

    The next message is found by an equi-join on (conversation, turn), which spreads
    one huge conversation over all tasks; turns are consecutive by construction.
    """
    replies = messages.filter((F.col("role") == "assistant") & F.col("text").contains(K.REFUSAL_PHRASE)).select(
        CONV, (F.col("turn") - 1).alias("turn"), F.lit(True).alias("refused"))
    asks = (F.col("role") == "user") & F.col("text").contains("?")
    return (
        messages.join(replies, [CONV, "turn"], "left")
        .withColumn("open", asks & F.coalesce("refused", F.lit(False))).drop("refused")
    )


def refused_questions(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text): user questions answered by a refusal in the next message."""
    return _mark_refused(messages).filter("open").select(CONV, "turn", "text")


def transcripts(messages: DataFrame, part_turns: int = 4096) -> DataFrame:
    """(conv_id, part_no, start, transcript): role-marked blocks in turn order.

    A part holds at most ``part_turns`` turns, so a conversation of any length is
    assembled by many tasks; joining the parts by newline gives the whole text, in
    which ``start`` is the place of the first character of the part.
    """
    block = (
        F.when(F.col("role") == "user", F.concat(F.lit("USER> "), F.col("text")))
        .when(F.col("role") == "assistant", F.concat(F.lit("ASSISTANT> "), F.col("text")))
        .otherwise(F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text")))
    )
    part = F.floor(F.col("turn") / part_turns).cast("int").alias("part_no")
    parts = messages.groupBy(CONV, part).agg(_joined("turn", F.concat(block, F.lit("\n")), "\n").alias("transcript"))
    before = Window.partitionBy(CONV).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(CONV, "part_no", F.length("transcript").alias("size")).select(
        CONV, "part_no", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).alias("start"))
    return parts.join(starts, [CONV, "part_no"]).select(CONV, "part_no", "start", "transcript")


def payload_summary(messages: DataFrame) -> DataFrame:
    """(conv_id, summary): message count, characters, payload hash and layout.

    Turns pass through their task in order, one at a time, and only the state of the
    hash, the counts and the layout are kept; no conversation is gathered.
    """
    kind = dict(messages.dtypes)[CONV]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, chars, layout, done = None, None, 0, [], []

        def summary() -> tuple:
            return now, (f"messages={len(layout)} | total_chars={chars} | payload_sha1={digest.hexdigest()[:12]} | "
                         f"layout={', '.join(layout)}")

        for frame in frames:
            for conv, role, text in zip(frame[CONV], frame["role"], frame["text"]):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append(summary())
                    now, digest, chars, layout = conv, hashlib.sha1(), 0, []
                digest.update(f"{role}\n{text}\n---\n".encode())
                chars += len(text)
                layout.append(f"{role}:{len(text)}")
            yield pd.DataFrame(done, columns=[CONV, "summary"])
            done = []
        if digest is not None:
            yield pd.DataFrame([summary()], columns=[CONV, "summary"])

    empty = F.lit("")
    rows = messages.select(CONV, "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.repartition(CONV).sortWithinPartitions(CONV, "turn").mapInPandas(run, f"`{CONV}` {kind}, summary string")


def summarize_sessions(messages: DataFrame, previous: DataFrame | None = None,
                       max_messages: int = K.MAX_HISTORY_TURNS) -> DataFrame:
    """(conv_id, summary): last three goals, last two conclusions and open questions of the recent messages."""
    newest = Window.partitionBy(CONV, "kind").orderBy(F.desc("turn"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    recent = recent_messages(_mark_refused(messages), max_messages)
    goal = F.concat(F.lit("- "), T.compact(F.col("text"), 280))
    conclusion = T.compact(F.col("text"), 320)
    question = F.concat(F.lit("- "), T.compact(F.col("text"), 160))
    items = F.array_compact(F.array(
        F.when(user, F.struct(F.lit(1).alias("kind"), goal.alias("line"))),
        F.when(assistant & ~conclusion.contains(K.REFUSAL_PHRASE),
               F.struct(F.lit(2).alias("kind"), F.concat(F.lit("- "), conclusion).alias("line"))),
        F.when(F.col("open"), F.struct(F.lit(3).alias("kind"), question.alias("line"))),
    ))
    picked = (
        recent.select(CONV, "turn", F.explode(items).alias("i")).select(CONV, "turn", "i.*")
        .withColumn("back", F.row_number().over(newest))
        .filter(((F.col("kind") == 1) & (F.col("back") <= 3)) | ((F.col("kind") == 2) & (F.col("back") <= 2))
                | (F.col("kind") == 3))
    )

    def section(kind: int, title: str) -> Column:
        lines = F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("turn", "line")))),
            lambda r: r["line"]), "\n")
        return F.when(F.count_if(F.col("kind") == kind) > 0, F.concat(F.lit(title + "\n"), lines))

    body = picked.groupBy(CONV).agg(F.concat_ws(
        "\n\n", section(1, "=== User goals (recent) ==="), section(2, "=== Assistant conclusions (recent) ==="),
        section(3, "=== Unresolved questions ===")).alias("body"))
    base = messages.select(CONV).distinct().join(body, CONV, "left")
    if previous is not None:
        base = base.join(previous.select(CONV, F.col("summary").alias("before")), CONV, "left")
    else:
        base = base.withColumn("before", F.lit(""))
    head = F.when(~T.is_blank(F.coalesce("before", F.lit(""))),
                  F.concat(F.lit("=== Previous summary ===\n"), T.compact(F.col("before"), 400)))
    text = F.concat_ws("\n\n", head, F.when(F.col("body") != "", F.col("body")))
    return base.select(CONV, F.when(text == "", "No persisted summary yet.").otherwise(text).alias("summary"))


def code_blocks(messages: DataFrame, key: list[str] = ["conv_id", "turn"], text: str = "text") -> DataFrame:
    """(key, block_no, language, code): fenced spans of each message, an open last fence included.

    Fence parity is a running count over the lines of the message.
    """
    order = Window.partitionBy(*key).orderBy("pos")
    lines = messages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    fence_at = F.locate("```", F.col("line"))
    lines = (
        lines.withColumn("at", fence_at).withColumn("fence", (F.col("at") > 0).cast("int"))
        .withColumn("fences", F.sum("fence").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("inside", ((F.col("fences") - F.col("fence")) % 2 == 1))
    )
    opening = (F.col("fence") == 1) & ~F.col("inside")
    span = F.floor((F.col("fences") + 1) / 2).cast("int")
    language = F.when(opening, T.trimmed(F.substring(F.col("line"), F.col("at") + 3, F.length("line"))))
    piece = F.when(F.col("inside"), F.when(F.col("fence") == 1, F.left(F.col("line"), F.col("at") - 1)).otherwise(
        F.col("line")))
    body = lines.filter(opening | F.col("inside")).withColumn(
        "span", F.when(F.col("inside") & (F.col("fence") == 1), F.floor(F.col("fences") / 2).cast("int")).otherwise(span))
    blocks = body.select(*key, "span", "pos", language.alias("language"), piece.alias("piece")).groupBy(*key, "span").agg(
        F.max("language").alias("language"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))),
                                 lambda r: r["piece"]), "\n").alias("code"))
    return (
        blocks.withColumn("code", T.trimmed(F.col("code"))).filter("code != ''")
        .withColumn("block_no", F.row_number().over(Window.partitionBy(*key).orderBy("span")))
        .select(*key, "block_no", "language", "code")
    )


def message_samples(messages: DataFrame) -> DataFrame:
    """(conv_id, line): one JSON line per conversation, messages in turn order."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return messages.groupBy(CONV).agg(F.to_json(F.struct(ordered.alias("messages"))).alias("line"))
