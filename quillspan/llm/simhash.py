"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Two fingerprints that differ in at most ``r`` bits differ in at most ``r // 3`` bits in one of three blocks of bits.  So
three vantage-point layouts, one for each block, split the fingerprints by the distance of the block to vantage
points; a fingerprint also visits the shards that lie behind a boundary within that radius.  Inside a shard a
vantage-point tree prunes branches by the triangle inequality, and its leaves compare whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import LOWER, id_and_text, small, utf8
from quillspan.llm.components import components
from quillspan.session import cut_lineage

WORDS_IN_SHINGLE = 4
MAX_BITS = 4
#: Lowest bit and number of bits of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Aim of distinct fingerprints in a shard; sets the depth of the layout, not the result.
SHARD_TARGET = 1024
LEAF = 64
#: Pairs compared at once in a leaf.
CELLS = 1 << 20


def fingerprint(text: bytes, words_in_shingle: int = WORDS_IN_SHINGLE) -> int:
    """A bit is set where it is set in over half the shingles' XXH64 (seed 42); no words give zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[min(len(words), words_in_shingle) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)
    )
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = WORDS_IN_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as signed long) of every whole text; null as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.fromiter(
                (fingerprint(t, words_in_shingle) for t in utf8(batch.column("text"))), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def vantage_points(block: int, depth: int) -> np.ndarray:
    """One vantage point for each level of the layout of a block, from a fixed hash: no data is needed to place them."""
    _, width = BLOCKS[block]
    return np.array(
        [xxhash.xxh64_intdigest(f"{block}:{level}") & ((1 << width) - 1) for level in range(depth)], dtype=np.uint64
    )


def block_of(fps: np.ndarray, block: int) -> np.ndarray:
    low, width = BLOCKS[block]
    return (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)


def route(fps: np.ndarray, block: int, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of each fingerprint's own shard and of the shards that it visits.

    At each level the near side holds block distances up to half the bits.  A shard is visited if a point within
    ``radius`` can lie there.  Only shards after the own one are visited: of two points the one that comes first visits.
    """
    rows, codes, homes = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    own = block_of(fps, block)
    for point in vantage_points(block, depth):
        distance = np.bitwise_count(own ^ point).astype(np.int64)
        half = BLOCKS[block][1] // 2
        far = (distance > half).astype(np.int64)
        homes = homes * 2 + far
        near_too, far_too = (distance - radius <= half)[rows], (distance + radius > half)[rows]
        rows, codes = (
            np.concatenate([rows[near_too], rows[far_too]]), np.concatenate([codes[near_too] * 2, codes[far_too] * 2 + 1])
        )
    ahead = codes >= homes[rows]
    rows, codes = rows[ahead], codes[ahead]
    return rows, codes, codes == homes[rows]


def close_pairs(own: np.ndarray, visitors: np.ndarray, block: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (in ``own``, in ``own`` then ``visitors``) within ``max_bits``, from one shard's tree."""
    every, radius = np.concatenate([own, visitors]), max_bits // 3
    keys = block_of(every, block)
    todo = [(np.arange(len(own)), np.arange(len(every)))]
    while todo:
        members, queries = todo.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) > LEAF:
            distance = np.bitwise_count(keys[members] ^ keys[members[len(members) // 2]]).astype(np.int64)
            bound = int(np.median(distance))
            near = distance <= bound
            if near.all():
                near, bound = distance < bound, bound - 1
            if near.any():
                asked = np.bitwise_count(keys[queries] ^ keys[members[len(members) // 2]]).astype(np.int64)
                todo.append((members[near], queries[asked - radius <= bound]))
                todo.append((members[~near], queries[asked + radius > bound]))
                continue
        step = max(1, CELLS // len(members))
        for at in range(0, len(queries), step):
            some = queries[at:at + step]
            i, j = np.nonzero(np.bitwise_count(every[members][:, None] ^ every[some][None, :]) <= max_bits)
            a, b = members[i], some[j]
            keep = a < b
            if keep.any():
                yield a[keep], b[keep]


def forest(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least position of each one's group, by union of the pairs as they come; only ``size`` numbers are held."""
    parent = np.arange(size)
    for a, b in pairs:
        while True:
            ra, rb = parent[a], parent[b]
            if (ra == rb).all():
                break
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return parent


def links(distinct: DataFrame, count: int, max_bits: int = MAX_BITS, shard_target: int = SHARD_TARGET) -> DataFrame:
    """Links (a, b) that connect every two fingerprints (``fp``, distinct) within ``max_bits``; ``count`` of them in all.

    A shard gives a spanning forest of its close pairs, so a dense group gives as many links as it has members.
    """
    depth = max(0, (max(1, count) - 1).bit_length() - (shard_target - 1).bit_length())
    radius = max_bits // 3

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for block in range(len(BLOCKS)):
                rows, shards, home = route(fps, block, depth, radius)
                yield pa.RecordBatch.from_arrays([
                    pa.array((shards * len(BLOCKS) + block).astype(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(home)
                ], ["shard", "fp", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        block, fps = int(group["shard"].iloc[0]) % len(BLOCKS), group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        own, visitors = fps[home], fps[~home]
        every = np.concatenate([own, visitors])
        root = forest(len(every), close_pairs(own, visitors, block, max_bits))
        moved = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"a": every[moved].view(np.int64), "b": every[root[moved]].view(np.int64)})

    return distinct.mapInArrow(spread, "shard bigint, fp bigint, home boolean").groupBy("shard").applyInPandas(
        search, "a bigint, b bigint"
    )


def near_duplicates(
    docs: DataFrame, words_in_shingle: int = WORDS_IN_SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links of ``max_bits`` or fewer.

    Null and blank texts have fingerprint zero and link like any other.  Equal fingerprints, so also repeated rows, are
    one node.  Null ids get the component of their fingerprint and never name one (a component of null ids alone has a
    null id).  An empty table gives an empty table; columns besides the two are not read.
    """
    marked = cut_lineage(fingerprints(docs, words_in_shingle, id_col, text_col), "simhash")
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    found = components(links(nodes.select("fp"), nodes.count(), max_bits))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
