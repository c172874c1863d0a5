"""Token ids as Parquet list columns, in document order, for selective reads of tokens and of their metadata.

One task writes one file (or several with the same part number) of documents in ascending order; a row holds the id, the
number of tokens, the place of its first token within the task's output, and the ids as a list.  Ids are dictionary
encoded or, with ``encoding="delta"``, delta packed; the sorted number columns are always delta packed.  Row groups and
pages have set sizes and every column has a page index, so a read of some documents or of some token positions opens
the pages that hold them, and a read of metadata opens no token page.  The place of a token in the whole store is the
place in its part plus the tokens of all earlier parts; those sums come from the metadata column alone.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from quillspan.llm import bpe
from quillspan.llm.common import id_and_text, small
from quillspan.session import scratch_path

SCHEMA = "doc_id bigint, n_tokens bigint, part_start bigint, ids array<int>"
IDS = "ids.list.element"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2000
END_ID = 0


class Encoder(bpe.Pieces):
    """Ids of whole texts as the library gives them: it is asked for each piece once, or for a text with added tokens."""

    def __init__(self, path: str):
        super().__init__(self)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.shown = {byte: char for char, byte in bpe.byte_alphabet().items()}
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.known, self.any = (regex.compile(p, regex.V1).findall for p in (bpe.KNOWN_PATTERN, bpe.PATTERN))
        self.latin, self.newer = re.compile(bpe.LATIN_PATTERN).findall, re.compile(f"[{bpe.UNKNOWN}]").search

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids by the library's model, which reads the printable characters that stand for bytes."""
        return [token.id for token in self.tokenize(piece.decode("latin-1").translate(self.shown))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            text.encode("latin-1")
            pieces = self.latin(text)
        except UnicodeEncodeError:
            pieces = (self.any if self.newer(text) else self.known)(text)
        return b"".join(map(self.__getitem__, pieces))


@contextmanager
def no_garbage_walks():
    """No collection of cycles meanwhile: the kept pieces hold none, and walking them takes a fifth of the time."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(ordered: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Rows of ``SCHEMA`` for the rows (doc_id, text) of every partition, in their order."""
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = encoder(tokenizer), 0
        for batch in small(batches):
            with no_garbage_walks():
                found = [model.encode(t or "") + end for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int64)
            flat = np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(at + ends[:-1]),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            ], ["doc_id", "n_tokens", "part_start", "ids"])
            at += int(ends[-1])

    return ordered.mapInArrow(run, SCHEMA)


def write(
    docs: DataFrame, tokenizer: str, path: str | None = None, encoding: str = "dictionary", end_id: int | None = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the tokens of every whole text and return the folder, by default a new one in the shared folder.

    Documents come in ascending order of id, null ids first; rows of one id by a hash of the text, equal rows as the input
    has them.  Rows are dealt out by ranges of these keys and of the row's place, so an id with very many rows is split
    as well.  A null or empty text holds ``end_id`` alone, or nothing without one.  An empty table gives an empty store;
    columns besides the two are not read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    keys = ["doc_id", "_hash", "_row"]
    rows = id_and_text(docs, id_col, text_col).select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    encoded(ordered, tokenizer, end_id).write.options(**{
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
        f"parquet.enable.dictionary#{IDS}": "true" if encoding == "dictionary" else "false", "compression": "zstd",
    }).parquet(path)
    return path


def _rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of the stored rows with ``part``, the number of the task that wrote them."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint").alias("part")
    return spark.read.schema(SCHEMA).parquet(path).select(part, *columns)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """part, start (tokens of all earlier parts), n_tokens, n_docs: one row for every part that has rows."""
    sums = _rows(spark, path, "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the store has parts
    return sums.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens", "n_docs")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """part, _start; two numbers for each task of the writing job, so it is sent to all readers."""
    return F.broadcast(parts(spark, path).select("part", F.col("start").alias("_start")))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and, with ``ids``, the ids; else no token page is read."""
    rows = _rows(spark, path, "doc_id", "n_tokens", "part_start", *["ids"] * ids)
    return rows.join(_starts(spark, path), "part").select("doc_id", (F.col("_start") + F.col("part_start")).alias("start"), "n_tokens", *["ids"] * ids)


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows of ``read`` with ids from ``first`` to ``last``; both bounds reach the page index."""
    return read(spark, path).where(F.col("doc_id").between(first, last))


def read_span(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """doc_id, start, ids: the tokens at places ``first`` to ``end`` (exclusive) of the store, one row for each document
    that has some, ``start`` being the place of the first of them.

    The parts that hold the span, as ranges of places within them, are few numbers that the driver puts into the filter,
    so that other files and pages are not read.
    """
    held = parts(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > first))
    held = held.agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("start").alias("a_start"), F.max("start").alias("b_start")).first()
    rows = _rows(spark, path, "doc_id", "n_tokens", "part_start", "ids")
    low, high = held["a"], held["b"]
    if low is None:
        return rows.where("false").select("doc_id", F.col("part_start").alias("start"), "ids")
    rows = rows.where(
        F.col("part").between(low, high)
        & ((F.col("part") > low) | (F.col("part_start") + F.col("n_tokens") > first - held["a_start"]))
        & ((F.col("part") < high) | (F.col("part_start") < end - held["b_start"]))
    )
    place = F.col("_start") + F.col("part_start")
    skip = F.greatest(F.lit(first) - place, F.lit(0))
    kept = F.least(F.lit(end) - place, F.col("n_tokens")) - skip
    return rows.join(_starts(spark, path), "part").where(kept > 0).select(
        "doc_id", (place + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), kept.cast("int")).alias("ids")
    )


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, over the ids as little-endian unsigned 32-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return stored.select("doc_id", "start", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
