"""Near copies by SimHash, checked and completed by exact Jaccard similarity of word shingles.

First the SimHash operator (``simhash.py``) links fingerprints within four bits; its links span every close family with
as many pairs as the family has members.  Texts of similarity 0.8 differ in about ten of 64 bits, and at a radius that holds
most of them the blocks of a fingerprint tell nothing apart, so MinHash bands complete the candidates: a pair that shares
``s`` of its shingles is missed with probability ``(1 - s ** ROWS) ** BANDS``, 3e-5 at 0.8.  The similarity of every
candidate pair is computed from the two whole texts before it becomes a link.

All pairs of a dense family are not needed for its component.  After SimHash each text of a bucket is compared with one
pivot of it, twice, with different pivots.  Texts of a bucket that are still in different components are described by their
edits against its first pivot and compared where they share one of their rarest edits, which two texts of that similarity
always do; neither a passage that many texts hold nor edits of one common text make many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import LOWER, cut_and_clean, small, utf8
from quillspan.llm.components import components
from quillspan.llm.simhash import fingerprint, links as close_fingerprints
from quillspan.session import cut_lineage

WORDS_IN_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Shingles hashed at once for a signature.
SLICE = 8192
_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, BANDS * ROWS).astype(np.uint64)


def shingles(text: bytes, size: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles; a text of fewer words is one shingle, a text without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[min(len(words), size) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two texts without words are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - shared
    return shared / every if every else 1.0


def bands(hashes: np.ndarray) -> list[int]:
    """One key of each band, as signed longs."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE]
        np.minimum(least, (_FACTORS[:, None] * part[None, :] + _OFFSETS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """doc_id, text, n (distinct shingles), keys (of the bands), fp (SimHash, signed) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = utf8(batch.column("text"))
            sets = [shingles(t, size) for t in texts]
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(fps.view(np.int64)),
            ], ["doc_id", "text", "n", "keys", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, text string, n bigint, keys array<bigint>, fp bigint")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that SimHash finds: each node with the least one of its fingerprint, and those of linked fingerprints."""
    least = cut_and_clean(nodes.groupBy("fp").agg(F.min("node").alias("b")), "near-prints")
    same = nodes.join(least, "fp").where("node > b").select(F.col("node").alias("a"), "b")
    near = close_fingerprints(least.select("fp"), least.count()).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    x, y = least.withColumnsRenamed({"fp": "fp_a", "b": "x"}), least.withColumnsRenamed({"fp": "fp_b", "b": "y"})
    met = near.join(x, "fp_a").join(y, "fp_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return met.unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def alike(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts (node, text) have at least the similarity ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a pivot comes in many rows one after the other
        for batch in small(batches):
            keep = []
            for a, b, text_a, text_b in zip(
                batch.column("a").to_pylist(), batch.column("b").to_pylist(), utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            ):
                held = {x: held[x] if x in held else shingles(t, size) for x, t in ((a, text_a), (b, text_b))}
                keep.append(similarity(held[a], held[b]) >= least - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x).filter(pa.array(keep, pa.bool_())) for x in ("a", "b")], ["a", "b"]
            )

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _fits(least: float):
    return F.least("n_x", "n_y") >= F.lit(least) * F.greatest("n_x", "n_y") - 1e-9


def _paired(joined: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of rows with nodes x, y and their counts; counts too far apart rule a pair out."""
    return joined.where(_fits(least)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pivot_pairs(rows: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs of each member of a bucket with the bucket's pivot, unless they are in one component already."""
    order = F.col("node") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
    pivots = rows.groupBy("key").agg(
        F.min_by(F.struct("node", "n", "label"), order).alias("p"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("key", F.col("p.node").alias("y"), F.col("p.n").alias("n_y"), F.col("p.label").alias("label_y"))
    joined = rows.join(pivots, "key").where("label <> label_y")
    return _paired(joined.withColumnsRenamed({"node": "x", "n": "n_x"}), least)


def shingle_rows(texts: DataFrame, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """(node, shingle) of every distinct shingle of the texts (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingles(t, size) for t in utf8(batch.column("text"))]
            node = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([
                pa.array(node, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)),
            ], ["node", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint")


def shingle_sets(texts: DataFrame, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """(node, shingles, times) of the texts (node, text) with words: sorted shingles, and how many of the texts hold each."""
    rows = cut_and_clean(shingle_rows(texts, size), "near-shingles")
    times = rows.groupBy("shingle").agg(F.count("*").alias("times"))
    held = rows.join(times, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("shingle", "times"))).alias("held"))
    return held.select("node", F.col("held.shingle").alias("shingles"), F.col("held.times").alias("times"))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Each list of longs as an array; null is an empty one."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [flat[a:b] if held else flat[:0] for a, b, held in zip(ends, ends[1:], column.is_valid().to_pylist())]


def lacking(members: DataFrame) -> DataFrame:
    """(pivot, lacks): how many members of each pivot lack each of its shingles, in their order.

    ``members``: pivot, shingles, of_pivot.  A task sums up the rows of a pivot that follow each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = sums = None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([pivot], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], ["pivot", "lacks"])
        for batch in small(batches):
            for at, own, of in zip(batch.column("pivot").to_pylist(), _arrays(batch.column("shingles")), _arrays(batch.column("of_pivot"))):
                if at != pivot:
                    if pivot is not None:
                        yield out()
                    pivot, sums = at, np.zeros(len(of), np.int64)
                sums += ~np.isin(of, own, assume_unique=True)
        if pivot is not None:
            yield out()

    parts = members.select("pivot", "shingles", "of_pivot").mapInArrow(run, "pivot bigint, lacks array<bigint>")
    summed = parts.select("pivot", F.posexplode("lacks").alias("at", "lack")).groupBy("pivot", "at").agg(F.sum("lack").alias("lack"))
    return summed.groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("at", "lack"))).alias("lacks")).select(
        "pivot", F.col("lacks.lack").alias("lacks"))


def edit_heads(members: DataFrame, least: float) -> DataFrame:
    """The rarest edits of each member (pivot, node, n, label, shingles, times, of_pivot, lacks) against its pivot.

    Edits are the shingles that only one of the two holds, ``edits`` in number, ordered by how many members share the edit
    (or a bound of it).  Edits of one member alone keep their place and make no row.
    """
    far = (1 - least) / least  # the most edits between two texts that are alike, a shingle of either

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            taken, edits, shingle, place = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, times, of, lacks, n in zip(*map(_arrays, (batch.column(x) for x in ("shingles", "times", "of_pivot", "lacks"))), batch.column("n").to_pylist()):
                more, less = ~np.isin(own, of, assume_unique=True), ~np.isin(of, own, assume_unique=True)
                edit, shared = np.concatenate([own[more], of[less]]), np.concatenate([times[more], lacks[less]])
                order = np.lexsort((edit, shared))[:int(far * n + 1e-6) + 1]
                at = np.flatnonzero(shared[order] > 1)
                taken.append(len(at))
                edits.append(len(edit))
                shingle.append(edit[order][at])
                place.append(at + 1)
            of = pa.array(np.repeat(np.arange(len(taken)), taken))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(x).take(of) for x in ("pivot", "node", "n", "label")), pa.array(np.repeat(edits, taken), pa.int64()),
                pa.array(np.concatenate(shingle)), pa.array(np.concatenate(place)),
            ], ["pivot", "node", "n", "label", "edits", "shingle", "place"])

    return members.select("pivot", "node", "n", "label", "shingles", "times", "of_pivot", "lacks").mapInArrow(
        run, "pivot bigint, node bigint, n bigint, label bigint, edits bigint, shingle bigint, place bigint")


def open_pairs(rows: DataFrame, texts: DataFrame, least: float, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """Pairs of members of a bucket that are in different components, where their rarest edits meet.

    Members are described by their edits against the least node of the bucket, which ``pivot_pairs`` has compared them with
    (``turn`` 0), so a passage or a whole text that they share counts nothing.  No pair of similarity ``least`` is left out:
    two texts of ``n`` and ``m`` shingles are alike if they differ in at most ``(1 - least) / (1 + least) * (n + m)`` shingles,
    which are the edits of one of the two alone, so they share ``need`` edits or more, and the first shared one stands early
    in both.  If ``need`` is zero both are alike to the pivot, thus in one component.
    """
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"))
    members = rows.join(pivots, "key").select("pivot", "node", "n", "label").distinct()
    mixed = members.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pivot")
    rest = cut_and_clean(members.join(mixed, "pivot"), "near-open")
    sets = cut_and_clean(shingle_sets(texts.join(rest.select("node").distinct(), "node", "left_semi"), size), "near-sets")
    of_pivot = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot"))
    held = rest.join(sets, "node", "left").join(of_pivot, "pivot", "left")
    lacks = cut_and_clean(lacking(held), "near-lacks")
    heads = cut_and_clean(edit_heads(held.join(lacks, "pivot", "left"), least), "near-heads")
    x, y = (heads.select("pivot", "shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "label", "edits", "place")))
            for side in "xy")
    x = x.where(F.col("place_x") <= F.floor(F.lit((1 - least) / least / 2) * F.col("n_x") + 1e-6) + 1)  # enough for the fewer edits
    need = (F.col("edits_x") + F.col("edits_y") - F.lit((1 - least) / (1 + least)) * (F.col("n_x") + F.col("n_y"))) / 2
    early = F.least(F.col("edits_x") - F.col("place_x"), F.col("edits_y") - F.col("place_y")) + 1 >= need - 1e-6
    fewer = F.struct("edits_x", "node_x") < F.struct("edits_y", "node_y")
    met = x.join(y, (x["pivot"] == y["pivot"]) & (x["shingle"] == y["shingle"]) & (F.col("label_x") != F.col("label_y")) & fewer & early & _fits(least))
    return _paired(met.withColumnsRenamed({"node_x": "x", "node_y": "y"}), least)


def near_copies(docs: DataFrame, least: float = SIMILARITY, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """doc_id, sha (SHA-256 of the text) of the rows of ``docs`` (doc_id, text) that are not the first of their component.

    Components are those of links of similarity ``least`` or more; the first has the smallest id (of equal ids the least
    digest).  Rows with a null id are not looked at; null texts count as empty.
    """
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = cut_lineage(signatures(read, size).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keyed = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    rows = cut_and_clean(keyed.join(shared, "key"), "near-rows")
    close = cut_and_clean(simhash_pairs(nodes.select("node", "fp")), "near-simhash")
    met = rows.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = cut_and_clean(nodes.select("node", "doc_id", "text").join(met, "node", "left_semi"), "near-texts")
    tested = links = found = None
    for turn in range(-1, 3):
        labelled = rows.withColumn("label", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn(
            "label", F.coalesce("root", "node")
        ).drop("root")
        if turn < 0:
            pairs = close
        else:
            pairs = pivot_pairs(labelled, turn, least) if turn < 2 else open_pairs(labelled, texts, least, size)
        pairs = cut_and_clean(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = cut_and_clean(alike(pairs, texts, least, size), "near-links")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        found = cut_lineage(components(links), "near-found")
    if found is None:
        return nodes.select("doc_id", F.lit("").alias("sha")).limit(0)
    placed = texts.select("node", F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("row")).join(found, "node")
    first = placed.groupBy("root").agg(F.min("row").alias("first"))
    return placed.join(first, "root").where("row <> first").select("row.doc_id", "row.sha").distinct()
