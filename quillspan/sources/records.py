"""JSON records: conversations, memories, search payloads, model streams, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan import constants as K
from quillspan.functions import policy as P, text as TX

CONVERSATION_SCHEMA = (
    "id string, title string, createdAt string, updatedAt string, summary string,"
    "messages array<struct<role:string,content:string,createdAt:string>>"
)
MEMORY_SCHEMA = (
    "id string, key string, value string, category string, createdAt string, updatedAt string,"
    "confidence double, pinned boolean"
)
_RESULT = ", ".join(f"{k}:string" for k in ["title", "url", *K.SNIPPET_KEYS])
SEARCH_SCHEMA = f"results array<struct<{_RESULT},descriptions:array<string>>>"
STREAM_SCHEMA = (
    "response string, thinking string, error string, done_reason string, prompt_eval_count int,"
    "prompt_eval_duration double, message struct<content:string,thinking:string>"
)
VECTOR_SCHEMA = "error string, embeddings array<array<float>>, embedding array<float>"


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def read_conversations(rows: DataFrame, json: str = "json") -> DataFrame:
    """(conversation_id, title, updated_at, turn, role, content) from one JSON document per row."""
    doc = F.from_json(F.col(json), CONVERSATION_SCHEMA)
    return (
        rows.select(doc.alias("d")).filter(_text("d.id") != "")
        .select(F.col("d.id").alias("conversation_id"), _text("d.title").alias("title"),
                _text("d.updatedAt").alias("updated_at"), F.posexplode("d.messages").alias("turn", "m"))
        .select("conversation_id", "title", "updated_at", "turn", _text("m.role").alias("role"),
                _text("m.content").alias("content"))
    )


def read_memories(rows: DataFrame, json: str = "json") -> DataFrame:
    """Memory rows from one JSON object per row; missing fields become defaults."""
    doc = F.from_json(F.col(json), MEMORY_SCHEMA)
    return rows.select(doc.alias("d")).filter("d.id IS NOT NULL").select(
        F.col("d.id").alias("id"), _text("d.key").alias("key"), _text("d.value").alias("value"),
        _text("d.category").alias("category"), _text("d.createdAt").alias("created_at"),
        _text("d.updatedAt").alias("updated_at"), F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("d.pinned", F.lit(False)).alias("pinned"))


def _descriptions(c: Column) -> Column:
    """Cleaned descriptions joined by spaces until 900 characters are reached."""
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), P.html_snippet)
    joined = F.aggregate(
        cleaned, F.lit(""),
        lambda acc, d: F.when((F.length(acc) >= K.SNIPPET_CHARS) | (d == ""), acc)
        .when(acc == "", d).otherwise(F.concat(acc, F.lit(" "), d)))
    return P.html_snippet(joined)


def parse_search_payload(rows: DataFrame, key: str = "request_id", json: str = "json") -> DataFrame:
    """(key, ord, title, url, snippet, domain): search results in payload order; empty ones dropped."""
    doc = F.from_json(F.col(json), SEARCH_SCHEMA)
    hits = rows.select(key, F.posexplode(doc["results"]).alias("ord", "r"))
    first = F.coalesce(*[F.nullif(P.html_snippet(_text(f"r.{name}")), F.lit("")) for name in K.SNIPPET_KEYS],
                       _descriptions(F.col("r.descriptions")))
    url = TX.trimmed(_text("r.url"))
    return (
        hits.select(key, "ord", P.html_snippet(_text("r.title")).alias("title"), url.alias("url"),
                    first.alias("content"))
        .filter((F.col("title") != "") | (F.col("content") != ""))
        .select(key, "ord", "title", "url", TX.trimmed(F.left("content", F.lit(K.SNIPPET_CHARS))).alias("snippet"),
                P.url_host(F.col("url")).alias("domain"))
    )


def parse_model_stream(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds delta, thinking, error, done_reason, eval_count, eval_ns and bad_json to NDJSON rows.

    Works on batch and streaming frames.  Blank lines are dropped; a line with an
    error carries nothing else.
    """
    text = TX.trimmed(F.col(line))
    rows = lines.filter(text != "").withColumn("_d", F.from_json(text, STREAM_SCHEMA))
    rows = rows.withColumn("bad_json", ~text.startswith("{") | F.col("_d").isNull()
                           | F.get_json_object(text, "$").isNull())
    error = TX.trimmed(_text("_d.error"))
    ok = error == ""

    def either(a: str, b: str) -> Column:
        return F.when(ok, F.when(_text(a) != "", _text(a)).otherwise(_text(b))).otherwise("")

    return (
        rows.withColumn("error", error)
        .withColumn("delta", either("_d.response", "_d.message.content"))
        .withColumn("thinking", either("_d.thinking", "_d.message.thinking"))
        .withColumn("done_reason", F.when(ok, TX.trimmed(_text("_d.done_reason"))).otherwise(""))
        .withColumn("eval_count", F.when(ok, F.col("_d.prompt_eval_count")))
        .withColumn("eval_ns", F.when(ok, F.col("_d.prompt_eval_duration").cast("long")))
        .drop("_d")
    )


def parse_embedding_payload(rows: DataFrame, key: str = "request_id", json: str = "json") -> DataFrame:
    """(key, item_no, embedding): vectors of a response; an error or any empty vector fails the whole response."""
    doc = F.from_json(F.col(json), VECTOR_SCHEMA)
    legacy = F.when(F.size("d.embedding") > 0, F.array("d.embedding"))
    vectors = F.when(F.size("d.embeddings") > 0, F.col("d.embeddings")).otherwise(legacy)
    return (
        rows.select(key, doc.alias("d")).filter(TX.trimmed(_text("d.error")) == "")
        .withColumn("vectors", vectors)
        .filter(F.forall("vectors", lambda v: F.size(v) > 0))
        .select(key, F.posexplode("vectors").alias("item_no", "embedding"))
    )
