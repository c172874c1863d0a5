"""Chunk packing, filtering, duplicate removal, numbering and refresh."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillspan.functions import budgets as B, lines as L, text as T
from quillspan.operators.frames import empty
from quillspan.operators.positions import number_rows

CHUNK_TYPE = "array<struct<text:string,embedding:array<float>>>"


def pack_chunks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``chunks`` to rows of (blocks, profile[, vectors]).

    One row is one document, so packing is narrow: no group is formed and no
    exchange happens.
    """
    from quillspan.operators.packing import pack_blocks

    def pack(rows: pd.Series, profile: pd.DataFrame, vectors: pd.Series | None = None) -> pd.Series:
        out = []
        for i, parts in enumerate(rows):
            p = profile.iloc[i]
            vecs = None if vectors is None or vectors.iloc[i] is None else list(vectors.iloc[i])
            packed = pack_blocks(
                [] if parts is None else list(parts), int(p["target_chars"]), int(p["minimum_chars"]),
                int(p["hard_chars"]), int(p["overlap_chars"]), vecs,
            )
            out.append([{"text": t, "embedding": v} for t, v in packed])
        return pd.Series(out)

    if "vectors" in blocks.columns:
        @F.pandas_udf(CHUNK_TYPE)
        def run(rows: pd.Series, profile: pd.DataFrame, vectors: pd.Series) -> pd.Series:
            return pack(rows, profile, vectors)

        return blocks.withColumn("chunks", run.asNondeterministic()("blocks", "profile", "vectors"))

    @F.pandas_udf(CHUNK_TYPE)
    def run_plain(rows: pd.Series, profile: pd.DataFrame) -> pd.Series:
        return pack(rows, profile)

    # else the optimizer runs it once for a filter below the explode and once more for the rows
    return blocks.withColumn("chunks", run_plain.asNondeterministic()("blocks", "profile"))


def with_profile(docs: DataFrame, semantic: bool = False) -> DataFrame:
    """Adds ``profile`` from (source_type, size_bytes, blocks)."""
    return docs.withColumn(
        "profile",
        B.chunking_profile(F.col("source_type"), F.col("size_bytes"), F.lit(semantic), F.size("blocks")),
    )


def explode_chunks(packed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pos, text, embedding, fingerprint, kept): candidate chunks in order."""
    rows = packed.select(*keep, F.posexplode("chunks").alias("pos", "chunk"))
    text = T.trimmed(F.col("chunk.text"))
    return rows.select(
        *keep, "pos", text.alias("text"), F.col("chunk.embedding").alias("embedding"),
        T.fingerprint(text).alias("fingerprint"), L.keep_chunk(text).alias("kept"),
    )


def drop_duplicates_in_doc(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep the first of equal fingerprints inside each document."""
    first = Window.partitionBy(key, "fingerprint").orderBy("pos")
    return chunks.withColumn("copy_no", F.row_number().over(first)).filter("copy_no = 1").drop("copy_no")


def number_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dense 0-based ``chunk_index`` in position order."""
    order = Window.partitionBy(key).orderBy("pos")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def chunk_tallies(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, candidates, filtered, duplicates, chunks) of candidate rows."""
    first = Window.partitionBy(key, "fingerprint").orderBy("pos")
    copies = candidates.withColumn(
        "copy_no", F.when(F.col("kept"), F.sum(F.col("kept").cast("int")).over(
            first.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return copies.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~F.col("kept")).alias("filtered"),
        F.count_if(F.col("copy_no") > 1).alias("duplicates"),
        F.count_if(F.col("copy_no") == 1).alias("chunks"),
    )


def share_embeddings(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Fill ``embedding`` from any indexed chunk with the same fingerprint.

    The donor per fingerprint is the first by (path, chunk_index).  ``min_by`` is
    combined map-side, so a fingerprint shared by very many chunks costs one row
    per task; on the probe side a hot fingerprint is split by the skew join.
    """
    donors = (
        indexed.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .groupBy("fingerprint")
        .agg(F.min_by("embedding", F.struct("path", "chunk_index")).alias("shared_embedding"))
    )
    return (
        chunks.join(donors, "fingerprint", "left")
        .withColumn("shared", F.col("shared_embedding").isNotNull())
        .withColumn("embedding", F.coalesce("shared_embedding", "embedding"))
        .drop("shared_embedding")
    )


def refresh_chunks(indexed: DataFrame, statuses: DataFrame, rebuilt: DataFrame, key: str = "path") -> DataFrame:
    """Keep chunks of unchanged or touched files, take rebuilt ones for the rest.

    With ``now_ms`` in ``statuses`` the chunks of touched files get it as their time.
    """
    kept = statuses.filter(F.col("status").isin("unchanged", "touched"))
    if "now_ms" not in statuses.columns:
        return indexed.join(kept.select(key), key, "left_semi").unionByName(rebuilt, allowMissingColumns=True)
    stamped = indexed.join(kept.select(key, "now_ms"), key).withColumn("modified_ms", F.coalesce("now_ms", "modified_ms"))
    return stamped.drop("now_ms").unionByName(rebuilt, allowMissingColumns=True)


def preview_chunks(chunks: DataFrame, key: str = "path", order: str = "chunk_index") -> DataFrame:
    """All chunks of files with up to eight, else the first four and last two, as short previews."""
    by_file = Window.partitionBy(key)
    ranked = chunks.withColumn("rank", F.row_number().over(by_file.orderBy(order))).withColumn(
        "total", F.count(F.lit(1)).over(by_file)
    )
    shown = ranked.filter((F.col("total") <= 8) | (F.col("rank") <= 4) | (F.col("rank") > F.col("total") - 2))
    return shown.select(
        key, order, F.length("text").alias("char_count"), T.count_words(F.col("text")).alias("word_count"),
        T.compact_preview(F.col("text"), 900).alias("preview"),
    )


def _runs(sizes: list[tuple[int, int]], taken: int, size: int, chars: int, tokens: int):
    """For each text whether it starts a batch, when the open batch holds the ``taken`` texts before the first of them.

    ``sizes`` are (characters, tokens) of those ``taken`` texts and of the texts themselves.
    """
    count = used_chars = used_tokens = 0
    for place, (text_chars, text_tokens) in enumerate(sizes):
        more_chars, more_tokens = used_chars + (count > 0) + text_chars, used_tokens + 4 * (count > 0) + text_tokens
        fits = count and (place < taken or count < size and more_chars <= chars and more_tokens <= tokens)
        if not fits:
            count, more_chars, more_tokens = 0, text_chars, text_tokens
        count, used_chars, used_tokens = count + 1, more_chars, more_tokens
        if place >= taken:
            yield not fits, count


def batch_texts(texts: DataFrame, group: str, order: str, text: str = "text", size: int = 4,
                chars: int = 1800, tokens: int = 520, slice_rows: int = 4096) -> DataFrame:
    """Adds ``batch_no`` within the group: batches of at most ``size`` texts and the two budgets, in order.

    Whether a text starts a batch depends on the text before it, so batches are made in three steps.  A slice of rows says
    for every number of texts that the open batch may bring along what it hands on; slices chain by these functions; then
    each slice is cut with what it really receives.  So a hot group is cut by many tasks, with the batches of one pass.
    (group, order) is unique.
    """
    whole = F.struct(F.col(group).alias("g"))
    sized = texts.select(whole.alias("whole"), F.col(order).alias("ord"), F.length(text).alias("chars"), T.estimate_tokens(F.col(text)).alias("tokens"))
    sized = sized.select(F.to_json("whole", {"ignoreNullFields": "false"}).alias("grp"), "ord", "chars", "tokens")
    rows = number_rows(sized, ["grp"], [F.col("ord")])
    here = F.floor(F.col("place") / slice_rows)
    handed = F.col("place") % slice_rows >= slice_rows - (size - 1)  # the next slice may find these in its open batch
    rows = rows.withColumn("slice", F.explode(F.when(handed, F.array(here, here + 1)).otherwise(F.array(here))))
    rows = rows.withColumn("before", F.col("slice") > here)

    def parts(frame: pd.DataFrame) -> tuple[list, list, pd.DataFrame]:
        frame = frame.sort_values("place")
        sizes = list(zip(frame["chars"].tolist(), frame["tokens"].tolist()))
        split = int(frame["before"].sum())
        return sizes[:split], sizes[split:], frame[~frame["before"]]

    def ways(frame: pd.DataFrame) -> pd.DataFrame:
        before, own, _ = parts(frame)
        out = []
        for taken in range(len(before) + 1 if own else 0):
            steps = list(_runs(before[len(before) - taken:] + own, taken, size, chars, tokens))
            out.append((taken, steps[-1][1] % size, sum(fresh for fresh, _ in steps)))
        if not out:
            return empty(["grp", "slice", "taken", "given", "batches"])
        return pd.DataFrame(out, columns=["taken", "given", "batches"]).assign(grp=frame["grp"].iloc[0], slice=frame["slice"].iloc[0])

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        table = {(s, t): (given, n) for s, t, given, n in zip(frame["slice"], frame["taken"], frame["given"], frame["batches"])}
        out, taken, first = [], 0, 0
        for number in range(int(frame["slice"].max()) + 1):
            out.append((frame["grp"].iloc[0], number, taken, first))
            taken, made = table[(number, taken)]
            first += made
        return pd.DataFrame(out, columns=["grp", "slice", "taken", "first"])

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        before, own, rows_here = parts(frame)
        taken, first = int(frame["taken"].iloc[0]), int(frame["first"].iloc[0])
        if not own:
            return empty(["grp", "ord", "batch_no"])
        fresh = [f for f, _ in _runs(before[len(before) - taken:] + own, taken, size, chars, tokens)]
        return pd.DataFrame({"grp": rows_here["grp"].astype(object), "ord": rows_here["ord"], "batch_no": first - 1 + pd.Series(fresh, dtype="int64").cumsum().to_numpy()})

    kind = dict(rows.dtypes)["ord"]
    steps = rows.groupBy("grp", "slice").applyInPandas(ways, "grp string, slice bigint, taken int, given int, batches bigint")
    starts = steps.groupBy("grp").applyInPandas(chained, "grp string, slice bigint, taken int, first bigint")
    planned = rows.join(starts, ["grp", "slice"]).groupBy("grp", "slice").applyInPandas(cut, f"grp string, ord {kind}, batch_no bigint")
    named = F.to_json(F.struct(texts[group].alias("g")), {"ignoreNullFields": "false"})
    return texts.join(planned, (named == planned["grp"]) & (texts[order] == planned["ord"])).drop("grp").drop(planned["ord"])
