"""Memory table: extraction, upsert, edits, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan import constants as K
from quillspan.functions import labels as LB, terms as TM, text as T
from quillspan.operators.frames import empty, plain
from quillspan.operators.positions import number_rows
from quillspan.operators.search_index import BLOCK_SHIFT, sliced

FIELDS = ["key", "value", "category", "confidence"]


def strip_directive(c: Column, patterns: list[str]) -> Column:
    """Drop the first pattern that matches at the start."""
    text = T.trimmed(c)
    out = None
    for pattern in patterns:
        cut = T.trimmed(F.regexp_replace(text, pattern, ""))
        out = F.when(text.rlike(pattern), cut) if out is None else out.when(text.rlike(pattern), cut)
    return out.otherwise(text)


def extract_memories(messages: DataFrame, text: str = "text", keep: list[str] = ["conv_id", "turn"]) -> DataFrame:
    """(keep..., key, value, category, confidence): explicit, preference and version memories of user text.

    The three rules are array entries of one pass, so the messages are read once.
    """
    body = T.trimmed(F.col(text))
    lower = F.lower(body)

    def starts(prefixes: list[str]) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | lower.startswith(prefix)
        return hit

    def entry(key: Column, value: Column, category: str, confidence: float) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), F.lit(category).alias("category"),
                        F.lit(confidence).alias("confidence"))

    note = LB.memory_value(strip_directive(body, K.RE_REMEMBER))
    like = LB.memory_value(strip_directive(body, K.RE_PREFER))
    version = F.regexp_extract(body, K.RE_PLATFORM, 1)
    prefers = starts(K.PREFER_PREFIXES) | lower.contains("from now on")
    entries = F.array_compact(F.array(
        F.when(starts(K.REMEMBER_PREFIXES) & LB.prompt_safe_value(note),
               entry(LB.memory_key(F.left(note, F.lit(48))), note, "explicit-memory", 1.0)),
        F.when(prefers & LB.prompt_safe_value(like),
               entry(F.concat(F.lit("preference-"), LB.memory_key(F.left(like, F.lit(40)))), like, "preference", 0.95)),
        F.when(version != "", entry(F.lit("platform_version"), version, "environment", 0.9)),
    ))
    return messages.select(*keep, F.explode(entries).alias("m")).select(*keep, "m.*")


def upsert_memories(memories: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins.  An incoming row meets the stored row of its key and category, else the one of its id, else it is new.

    A key match keeps the stored id and ``created_at``; an id match takes the incoming row whole.  New rows of one key,
    or of one id, meet each other in the same way.  ``incoming`` carries ``seq``, its arrival order.  Targets come from
    equi-joins, results from grouped minima and maxima (map-side combined), so a key written very often is cheap.
    """
    fields = ["id", "key", "value", "category", "created_at", "updated_at", "confidence", "pinned"]
    keyed, by_key = F.col("key") != "", ["key", "category"]
    stored_keys = memories.where(keyed).groupBy(*by_key).agg(F.min("id").alias("key_id"))
    met = incoming.select(*fields, "seq").join(stored_keys, by_key, "left").join(
        memories.select("id", F.col("id").alias("known_id")).distinct(), "id", "left")
    fresh = met.where(keyed & F.col("key_id").isNull() & F.col("known_id").isNull())
    first_ids = fresh.groupBy(*by_key).agg(F.min_by("id", "seq").alias("new_id"))
    arrived = met.join(first_ids, by_key, "left").select(
        *fields, F.struct(F.lit(1).alias("arrived"), "seq", "id").alias("place"),
        F.coalesce("key_id", "known_id", "new_id", "id").alias("slot"))
    stored = memories.select(*fields, F.struct(
        F.lit(0).alias("arrived"), F.lit(None).cast(incoming.schema["seq"].dataType).alias("seq"), "id").alias("place"), F.col("id").alias("slot"))
    rows = stored.unionByName(arrived)
    last = rows.groupBy("slot").agg(F.max_by(F.struct(*fields), "place").alias("r"))
    both = rows.join(last, "slot")
    other = ~keyed | (F.col("key") != F.col("r.key")) | (F.col("category") != F.col("r.category"))
    turns = both.groupBy("slot").agg(F.max(F.when(other, F.col("place"))).alias("turn"))  # the last row under another key
    stamps = (
        rows.join(turns, "slot").where((F.col("turn").isNull() | (F.col("place") > F.col("turn"))) & (F.col("created_at") != ""))
        .groupBy("slot").agg(F.min_by("created_at", "place").alias("created"))
    )
    return last.join(stamps, "slot", "left").select(
        F.col("slot").alias("id"), "r.key", "r.value", "r.category", F.coalesce("created", "r.created_at", F.lit("")).alias("created_at"),
        "r.updated_at", "r.confidence", "r.pinned")


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select(F.trim("id").alias("id")).distinct(), "id", "left_anti")


def edit_memories(memories: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Replace value and pin flag by id; blank values are ignored; id, key, category and created_at stay."""
    change = edits.filter(~T.is_blank(F.col("value"))).select(
        "id", T.compact(F.col("value"), 500).alias("new_value"), F.col("pinned").alias("new_pinned"))
    hit = F.col("new_value").isNotNull()
    return (
        memories.join(change, "id", "left")
        .withColumn("value", F.coalesce("new_value", "value"))
        .withColumn("pinned", F.coalesce("new_pinned", "pinned"))
        .withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")))
        .drop("new_value", "new_pinned")
    )


def order_memories(memories: DataFrame) -> DataFrame:
    """``memories`` with ``place``, from 0: pinned ones first, then the latest."""
    return number_rows(memories, [], [F.desc("pinned"), F.desc("updated_at"), F.col("id")])


def _base_score() -> Column:
    """Score of a memory that matches no term."""
    trust = F.when(F.col("confidence") >= 0.95, 4).when(F.col("confidence") >= 0.80, 2).otherwise(0)
    return F.when(F.col("pinned"), 8).otherwise(0) + trust


def _rank(*extra: Column) -> list[Column]:
    return [F.desc("total"), F.desc("pinned"), F.desc("updated_at"), F.col("id"), *extra]


def _memory_matches(pool: int | None):
    """applyInPandas function of some memories and queries: scores of the memories that match a query, the ``pool`` best of each."""
    import ahocorasick
    import numpy as np
    import pandas as pd

    fields = (("key", 40, 24), ("category", 20, 12), ("value", 10, 10))

    def run(memories: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        terms = sorted({t for ts in asked["terms"] for t in ts})
        if not terms or memories.empty:
            return empty(["query_id", "id", "score"])
        machine, number = ahocorasick.Automaton(), {t: k for k, t in enumerate(terms)}
        for term, k in number.items():
            machine.add_word(term, (k, len(term)))
        machine.make_automaton()
        points, present = np.zeros((len(terms), len(memories)), np.int32), np.zeros((len(terms), len(memories)), bool)
        for field, whole, part in fields:
            for row, (text, size) in enumerate(zip(memories[field], memories[f"{field}_size"])):
                for k, length in {found for _, found in machine.iter(text or "")}:
                    points[k, row] += whole if length == size else part
                    present[k, row] = True
        base, order = memories["base"].to_numpy(), memories["place"].to_numpy()
        for query_id, ts in zip(asked["query_id"], asked["terms"]):
            ids = [number[t] for t in ts]
            if ids:
                some = np.flatnonzero(present[ids].any(axis=0))
                score = points[ids][:, some].sum(axis=0) + 3 * present[ids][:, some].sum(axis=0) + base[some]
                if pool is not None:
                    best = np.lexsort((order[some], -(score + memories["lift"].to_numpy()[some])))[:pool]
                    some, score = some[best], score[best]
                out.append(pd.DataFrame({"query_id": query_id, "id": memories["id"].to_numpy()[some], "score": score}))
        return plain(pd.concat(out)) if out else empty(["query_id", "id", "score"])

    return run


def memory_scores(memories: DataFrame, queries: DataFrame, pool: int | None = None) -> DataFrame:
    """(query_id, id, score) of memories with a matched term; with ``pool`` those that can be among a query's best ``pool``.

    Memories are dealt out in blocks and meet the queries in slices; a task scores one block for one slice and sends on the
    best ``pool`` of each query, so pairs are cut before they are exchanged.
    """
    terms = sliced(queries.select("query_id", TM.memory_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0))
    text = [c for f in ("key", "category", "value") for c in (F.lower(f).alias(f), F.length(f).alias(f"{f}_size"))]
    ranked = memories.select(
        "id", *text, _base_score().alias("base"), F.when(F.col("pinned"), 50).otherwise(0).alias("lift"), "pinned", "updated_at",
        F.pmod(F.xxhash64("id"), F.lit(max(1, memories.count() >> BLOCK_SHIFT))).alias("block"),
    )
    in_block = Window.partitionBy("block").orderBy(F.desc("pinned"), F.desc("updated_at"), "id")
    ranked = ranked.withColumn("place", F.row_number().over(in_block))
    slices = F.explode(F.sequence(F.lit(0), terms.agg(F.max("slice")).scalar()))
    blocks = ranked.withColumn("slice", slices)
    asked = terms.join(blocks.select(F.col("block").alias("block"), F.col("slice").alias("slice")).distinct(), "slice").select(
        F.col("slice").alias("slice"), "block", "query_id", "terms")
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"]
    return blocks.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInPandas(
        _memory_matches(pool), f"query_id {kind}, id string, score int")


def relevant_memories(memories: DataFrame, queries: DataFrame, limit: int = K.MAX_MEMORIES,
                      require_match: bool = False) -> DataFrame:
    """Ranked memories per query, safe for prompts.

    Candidates are the matched pairs plus, for every query, the 2k best memories by
    their match-free score: a memory outside those that matches nothing is always
    behind 2k others, so the result is exact.  Those 2k rows reach the queries as
    one array value.  Safe filtering comes after the 2k cut, then the limit.
    """
    pool = 2 * limit
    matched = memory_scores(memories, queries, pool)
    pairs = matched
    if not require_match:
        no_terms = F.size(TM.memory_terms(F.col("query"))) == 0
        lift = F.when(F.col("pinned"), 50).otherwise(0)
        scored = memories.withColumn("base", _base_score()).filter((F.col("base") > 0) | F.col("pinned"))
        best = scored.withColumn("total", F.col("base") + lift).orderBy(*_rank()).limit(pool)
        newest = scored.filter("pinned").orderBy(F.desc("updated_at"), "id").limit(pool)
        top = best.select("id", "base", F.lit(False).alias("termless")).unionByName(
            newest.select("id", F.lit(1).alias("base"), F.lit(True).alias("termless"))
        ).agg(F.collect_list(F.struct("id", "base", "termless")).alias("top"))
        plain = (
            queries.select("query_id", no_terms.alias("no_terms"), top.scalar().alias("top"))
            .select("query_id", "no_terms", F.explode("top").alias("m"))
            .filter(F.col("m.termless") == F.col("no_terms"))
            .select("query_id", F.col("m.id").alias("id"), F.col("m.base").cast("int").alias("score"))
        )
        pairs = matched.unionByName(plain).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = (
        pairs.join(memories, "id").join(queries.select("query_id", "query"), "query_id")
        .withColumn("total", F.col("score") + F.when(F.col("pinned"), 50).otherwise(0))
        .withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_rank())))
        .filter(F.col("pool_rank") <= pool)
        .filter(LB.prompt_safe_memory(F.col("value"), F.col("query")))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pool_rank")))
    )
    return ranked.filter(F.col("rank") <= limit).drop("query", "pool_rank")


def memory_context(ranked: DataFrame) -> DataFrame:
    """(query_id, memory_context): one line per memory in rank order."""
    line = LB.memory_line(F.col("category"), F.col("key"), F.col("value"))
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda r: r["l"]), "\n")
        .alias("memory_context"))


def memory_cards(memories: DataFrame) -> DataFrame:
    """(id, card): display fields of each memory as JSON."""
    about = LB.memory_description(F.col("category"), F.col("key"), F.col("value"))
    return memories.select("id", F.to_json(F.struct(
        "id", "category", "key", "value", "updated_at", "created_at", "confidence", "pinned",
        about.alias("description"))).alias("card"))
