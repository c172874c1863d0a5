"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block (a line) matches a template if it holds at least ``threshold`` of the template's distinct words.  Words are
ordered by how often they stand in all documents, rarest first.  A match must hold one of the first ``t - a + 1`` of a
template's ``t`` words (``a``: the words it must share), so only blocks with such a word are paired (prefix filter);
pairs of blocks with too few words (length filter), or with too few words left after the first shared one (positional
filter), go before the overlap is counted.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.session import cut_lineage

# Phrases of the base rule, words and blocks.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"\n"
#: Notices to find, by label; public license wording.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
            " Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
            " the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Words with ASCII letters in lower case.

    ``lower`` also changes other letters, which no ASCII word can tell; the Kelvin sign, the one character that it would
    turn into an ASCII letter alone, is replaced by another letter first.
    """
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each template."""
    return [(label, sorted(set(re.findall(WORD, text.lower())))) for label, text in templates]


def read_blocks(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``texts`` (key columns, ``text``) with ``words`` and ``blocks`` in place of the text.

    Words are taken once, block by block (no word holds a line feed), and ``words`` is all of them in order.  A block has
    its number, its count of distinct words and its words of ``vocabulary``; blocks without any are left out.
    """
    keys = [c for c in texts.columns if c != "text"]
    worded = texts.select(*keys, F.transform(F.split("text", BLOCK_END), words_of).alias("block_words"))
    hits = F.transform("block_words", lambda ws: F.filter(ws, lambda w: w.isin(vocabulary)))
    blocks = worded.select(*keys, F.flatten("block_words").alias("words"), "block_words", hits.alias("hits")).withColumn(
        "blocks", F.transform("hits", lambda held, k: F.struct(
            k.cast("int").alias("block"), held.alias("hits"),
            F.when(F.size(held) > 0, F.size(F.array_distinct(F.get("block_words", k)))).alias("n"),
        )),
    )
    return blocks.select(*keys, "words", F.filter("blocks", lambda b: F.size(b["hits"]) > 0).alias("blocks"))


def global_order(blocks: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words from rare to frequent over all ``blocks``; as many rows as the templates have words."""
    counted = blocks.select(F.explode("hits").alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_matches(blocks: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matching (key columns, block, label, containment) of ``blocks``: key columns, ``block``, ``hits`` and ``n``."""
    spark, keys = blocks.sparkSession, [c for c in blocks.columns if c not in ("block", "hits", "n")]
    sets = template_words(templates)
    order = global_order(blocks, sorted({w for _, ws in sets for w in ws}))
    rank = {w: k + 1 for k, w in enumerate(order)}
    entries = []
    for label, ws in sets:
        ranks = sorted(rank[w] for w in ws)
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        entries += [(order[r - 1], r, j, label, ranks, need) for j, r in enumerate(ranks[:len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(  # a row for each prefix word of a template: bounded by the templates
        entries, "word string, word_rank int, j int, label string, template_ranks array<int>, need int"
    )
    listed = F.array(*map(F.lit, order))
    first_words = sorted({e[0] for e in entries})
    # blocks without any prefix word, or with too few words for any template, go before their words are ranked
    some = blocks.where(F.col("n") >= min((e[5] for e in entries), default=0)).where(
        F.arrays_overlap("hits", F.array(*map(F.lit, first_words))))
    ranked = some.select(*keys, "block", "n", F.array_distinct("hits").alias("block_words")).withColumn(
        "block_ranks", F.array_sort(F.transform("block_words", lambda w: F.array_position(listed, w).cast("int")))
    ).select("*", F.explode("block_words").alias("word")).where(F.col("word").isin(first_words))
    pairs = ranked.join(F.broadcast(prefixes), "word").where(F.col("n") >= F.col("need"))
    shared = F.array_intersect("block_ranks", "template_ranks")
    at = F.array_position("block_ranks", F.col("word_rank"))
    after = F.least(F.size("block_ranks") - at, F.size("template_ranks") - F.col("j") - 1)
    return (
        pairs.where((F.array_min(shared) == F.col("word_rank")) & (after + 1 >= F.col("need")))
        .withColumn("overlap", F.size(shared)).where("overlap >= need")
        .select(*keys, "block", "label", (F.col("overlap") / F.size("template_ranks")).alias("containment"))
    )


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (words from 0) of the places where the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")
    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & (F.get(words, i + k) == F.lit(part))
        return found
    none = F.array().cast("array<int>")
    return F.when(
        F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]),
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(here(i), F.lit(False))),
    ).otherwise(none)


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (comma-joined), score.

    ``score`` is 1 with a base phrase, else the best containment of a matching block, else 0.  Null texts count as empty:
    no words and labels, score 0, null places.  Null ids and repeated rows give rows of their own (equal rows have equal
    results).  An empty table gives an empty table; columns besides the two are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.char_length(text).alias("n_chars"),
        text.alias("text"),
    )
    keys = ["doc_id", "text_hash", "n_chars"]
    read = read_blocks(texts, sorted({w for _, ws in template_words(templates) for w in ws}))
    placed = cut_lineage(read.select(  # texts are read once; of their words the counts, places and template words are kept
        *keys, F.size("words").cast("bigint").alias("n_words"),
        *(phrase_places(F.col("words"), phrase).alias(f"places_{label}") for phrase, label in PHRASES), "blocks",
    ), "license-blocks")
    blocks = placed.select(*keys, F.inline("blocks"))
    found = template_matches(blocks, templates, threshold).groupBy(*keys).agg(
        F.collect_set("label").alias("found_labels"), F.max("containment").alias("best")  # at most one label per template
    )
    every = F.concat(*(F.col(f"places_{label}") for _, label in PHRASES))
    base = F.array_sort(F.filter(
        F.array(*(F.when(F.size(f"places_{label}") > 0, F.lit(label)) for _, label in PHRASES)), lambda x: x.isNotNull()
    ))
    based = placed.select(
        *keys, "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"), base.alias("base"),
    ).alias("b")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    labels = F.array_sort(F.array_union("base", F.coalesce("found_labels", F.array().cast("array<string>"))))
    return based.join(found.alias("f"), same[0] & same[1] & same[2], "left").select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def brute_force_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of ``scan_licenses`` over ``documents``: every block against every template."""
    rows = ", ".join(
        f"({k}, '{label}', [{', '.join(repr(w) for w in ws)}])" for k, (label, ws) in enumerate(template_words(templates))
    )
    words = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    here = lambda phrase: " AND ".join(
        f"coalesce(words[i + {k}] = '{w}', false)" for k, w in enumerate(phrase.split(" "))
    )
    places = ", ".join(f"list_filter(range(1, len(words) + 1), lambda i: {here(p)}) AS p_{label}" for p, label in PHRASES)
    cases = ", ".join(f"CASE WHEN len(p_{label}) > 0 THEN '{label}' END" for _, label in PHRASES)
    every = " || ".join(f"p_{label}" for _, label in PHRASES)
    return f"""
    WITH templates(k, label, ws) AS (VALUES {rows}),
    read AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    blocks AS (SELECT r, list_distinct({words('line')}) AS bw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM read)),
    matched AS (
      SELECT r, label, len(list_intersect(bw, ws)) / len(ws) AS c FROM blocks, templates
      WHERE len(list_intersect(bw, ws)) >= greatest(1, ceil({threshold} * len(ws) - 1e-9))
    ),
    found AS (SELECT r, list_distinct(list(label)) AS labels, max(c) AS best FROM matched GROUP BY r),
    worded AS (SELECT r, doc_id, {words('text')} AS words FROM read),
    placed AS (SELECT r, doc_id, len(words) AS n_words, {places} FROM worded),
    based AS (
      SELECT r, doc_id, n_words, {every} AS every, list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)) AS base FROM placed
    )
    SELECT doc_id, n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
           array_to_string(base, ',') AS base_labels,
           array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
           CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM based LEFT JOIN found USING (r)
    """
