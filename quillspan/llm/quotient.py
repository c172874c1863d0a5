"""Exact duplicates by counting quotient filters.

Each partition of the documents builds filters of its text fingerprints, one for each range of leading bits.  The
filters of one range, from all partitions, merge without loss, since each holds its fingerprints in order.  Only texts
whose fingerprint is counted more than once are sent on and compared byte for byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import SEPARATORS, id_and_text, small, utf8
from quillspan.session import cut_lineage

#: Fingerprints that a task gathers before it hands on filters; bounds its memory, not the result.
FILTER_ENTRIES = 2_000_000


class QuotientFilter:
    """Counts of 64-bit fingerprints that share their first ``lead`` bits.

    The next bits are the quotient; for each quotient the filter stores how many entries it has, and in order the
    remainders (the bits left over) with their counts.  Quotient and remainder give the fingerprint back, so merging
    and listing lose nothing.
    """

    def __init__(self, lead: int, shard: int, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints``: distinct, in ascending order."""
        self.lead, self.shard = lead, shard
        self.quotient_bits = min(40 - lead, max(1, int(len(fingerprints)).bit_length()))
        self.remainder_bits = 64 - lead - self.quotient_bits
        own = fingerprints & np.uint64((1 << (64 - lead)) - 1)
        quotients = (own >> np.uint64(self.remainder_bits)).astype(np.int64)
        self.runs = np.bincount(quotients, minlength=1 << self.quotient_bits).astype(np.uint32)
        self.remainders = own & np.uint64((1 << self.remainder_bits) - 1)
        self.counts = counts.astype(np.uint64)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        high = np.uint64(self.shard << (64 - self.lead)) if self.lead else np.uint64(0)
        return high | (quotients << np.uint64(self.remainder_bits)) | self.remainders

    def to_bytes(self) -> bytes:
        head = np.array([self.lead, self.shard, self.quotient_bits, len(self.remainders)], dtype="<u8")
        width = (self.remainder_bits + 7) // 8
        packed = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        return b"".join([head.tobytes(), self.runs.astype("<u4").tobytes(), packed.tobytes(), self.counts.astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        made = cls.__new__(cls)
        made.lead, made.shard, made.quotient_bits, n = map(int, np.frombuffer(data, "<u8", 4))
        made.remainder_bits = 64 - made.lead - made.quotient_bits
        width, at = (made.remainder_bits + 7) // 8, 32
        made.runs = np.frombuffer(data, "<u4", 1 << made.quotient_bits, at)
        at += made.runs.nbytes
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        made.remainders = wide.reshape(-1).view("<u8")
        made.counts = np.frombuffer(data, "<u8", n, at + n * width)
        return made

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Counts of all ``filters`` of one shard; a stable sort of runs that are in order is a merge."""
        every = np.concatenate([f.fingerprints() for f in filters])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], np.concatenate([f.counts for f in filters])[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return cls(filters[0].lead, filters[0].shard, every[first], np.add.reduceat(counts, first))


def partition_filters(fingerprints: np.ndarray, lead: int) -> Iterator[tuple[int, bytes]]:
    """Filters of some fingerprints, one for each shard that occurs."""
    distinct, counts = np.unique(fingerprints, return_counts=True)
    shards = (distinct >> np.uint64(64 - lead)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
    for a, b in zip(starts, [*starts[1:], len(shards)]):
        yield int(shards[a]), QuotientFilter(lead, int(shards[a]), distinct[a:b], counts[a:b]).to_bytes()


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, fp (XXH3 of the text without separators, as signed long), text_sha256, n_chars of the original, norm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            norms = [t.translate(None, SEPARATORS) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array(np.array([xxhash.xxh3_64_intdigest(n) for n in norms], dtype=np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(n).hexdigest() for n in norms], pa.string()),
                batch.column("n_chars"), pa.array(norms, pa.binary()),
            ], ["doc_id", "fp", "text_sha256", "n_chars", "norm"])

    lengths = docs.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return lengths.mapInArrow(run, "doc_id bigint, fp bigint, text_sha256 string, n_chars bigint, norm binary")


def repeated_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints that the merged filters count more than once: fp, n."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = max(1, math.ceil(math.log2(shards)) + 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(partition_filters(np.concatenate(held), lead)) if held else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"]
                )

        for batch in small(batches, 1024):
            held.append(np.array(
                [xxhash.xxh3_64_intdigest(t.translate(None, SEPARATORS)) for t in utf8(batch.column("text"))], dtype=np.uint64
            ))
            n += len(held[-1])
            if n >= FILTER_ENTRIES:
                yield from out()
                held, n = [], 0
        yield from out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = QuotientFilter.merge([QuotientFilter.from_bytes(f) for f in group["filter"]])
        more = merged.counts > 1
        return pd.DataFrame({"fp": merged.fingerprints()[more].view(np.int64), "n": merged.counts[more].astype(np.int64)})

    built = docs.select("text").mapInArrow(build, "shard int, filter binary")
    return built.groupBy("shard").applyInPandas(merge, "fp bigint, n bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without separators).

    Texts are equal when identical without the six separators.  Of equal texts the row with most code points in the
    original stays, of those the smallest id (a null id comes last).  Null and blank texts are one group, that of the
    empty text.  Rows that repeat an id and its text are members like others; ``kept`` is true for each row that has
    the kept id.  An empty table gives an empty table; columns besides the two are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    repeated = repeated_fingerprints(docs)
    routed = cut_lineage(
        normalised(docs).join(repeated, "fp", "left").select(
            "doc_id", "fp", "text_sha256", "n_chars", F.when(F.col("n").isNotNull(), F.col("norm")).alias("norm")
        ),
        "exact-dedup",
    )
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    groups = (  # grouping by the bytes themselves is the verification; equal rows of a task are combined before the exchange
        routed.where("norm is not null").groupBy("fp", "norm", "text_sha256").agg(best.alias("best"), F.count("*").alias("size"))
        .select("fp", "text_sha256", F.col("best.doc_id").alias("best_id"), "size")
    )
    joined = routed.drop("norm").join(groups, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )
