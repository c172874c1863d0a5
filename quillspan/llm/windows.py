"""Removal of word windows that an earlier document has, with a count-min prefilter.

A window of words is told by its minimizer, the least hash of the shorter shingles in it: equal windows have equal
minimizers, so the number of documents with a window's minimizer is never below the number with the window.  Tasks
sketch the minimizers of their documents; the merged sketch overestimates counts once more, and never counts too few.
Only windows whose estimate is two documents or more are grouped, by 128 bits of hashes of their words, in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import cut_and_clean, id_and_text, small, utf8

WINDOW = 13
#: Words of a shingle whose hashes stand for a window.
SHINGLE = 7
#: The sketch: rows of cells.  ROWS * CELLS / 8 bytes, one bit a cell, are what each task gets, whatever the data.
ROWS, CELLS = 2, 1 << 27
#: Cells merged by one group, and minimizers that a task gathers before it hands on a sketch.
PART_CELLS, SKETCH_KEYS = 1 << 20, 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.size = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up, self.down = (
                np.cumprod(np.append(np.uint64(1), np.full(self.size - 1, b)), dtype=np.uint64)
                for b in (np.uint64(self.base), np.uint64(pow(self.base, -1, 1 << 64)))
            )
        return self.up[:n], self.down[:n]


_POWERS = (Powers(0x9FB21C651E98DF25), Powers(0xD6E8FEB86659FD93))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Runs:
    """Hashes of runs of words, from prefix sums of the words' hashes times powers."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)
        self.hashes = (hashes, scramble(hashes))
        self.sums: dict[int, np.ndarray] = {}

    def of(self, which: int, at: np.ndarray | slice, size: int) -> np.ndarray:
        """64-bit hash of the run of ``size`` words at each place of ``at``; two families, ``which`` 0 and 1."""
        up, down = _POWERS[which].upto(self.n)
        if which not in self.sums:
            self.sums[which] = np.append(np.uint64(0), np.cumsum(self.hashes[which] * up, dtype=np.uint64))
        sums = self.sums[which]
        if isinstance(at, slice):
            at = np.arange(self.n - size + 1)
        return scramble((sums[at + size] - sums[at]) * down[at])

    def minimizers(self, window: int, shingle: int) -> np.ndarray:
        """The minimizer of each window; none if the text is shorter."""
        if self.n < window:
            return np.empty(0, np.uint64)
        span, width, least = window - shingle + 1, 1, self.of(0, slice(None), shingle)
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return np.minimum(least[:len(least) - (span - width)], least[span - width:])


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * _MIX[row]
    return (mixed >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def pack_cells(cells: np.ndarray) -> bytes:
    """Ascending cells as differences, byte planes apart, which compress well."""
    steps = np.diff(cells, prepend=0).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_cells(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def repeated_cells(docs: DataFrame, window: int, shingle: int, rows: int, cells: int) -> np.ndarray:
    """Bit of each cell (row x cell, packed) that two or more documents hit."""
    part_cells = min(PART_CELLS, cells)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            for row in range(rows):
                hit, counts = np.unique(cells_of(keys, row, cells), return_counts=True)
                parts, starts = np.unique(hit // part_cells, return_index=True)
                ends = [*starts[1:], len(hit)]
                local = hit % part_cells
                yield pa.RecordBatch.from_arrays([
                    pa.array(row * (cells // part_cells) + parts, pa.int64()),
                    pa.array([pack_cells(local[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([pack_cells(local[a:b][counts[a:b] > 1]) for a, b in zip(starts, ends)], pa.binary()),
                ], ["part", "once", "more"])

        for batch in small(batches):
            for text in utf8(batch.column("text")):
                held.append(np.unique(Runs(text).minimizers(window, shingle)))  # a document counts once
                n += len(held[-1])
            if n >= SKETCH_KEYS:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(part_cells, np.uint8)
        for once, more in zip(group["once"], group["more"]):
            for hit in (unpack_cells(once), unpack_cells(more)):
                counts[hit] = np.minimum(counts[hit] + 1, 2)
        bits = np.packbits(counts > 1, bitorder="little")
        return pd.DataFrame({"part": group["part"].iloc[:1], "bits": [bits.tobytes()]})

    merged = docs.select("text").mapInArrow(sketch, "part bigint, once binary, more binary").groupBy("part").applyInPandas(
        merge, "part bigint, bits binary"
    )
    out = np.zeros((rows * (cells // part_cells), max(1, part_cells // 8)), np.uint8)
    for part in merged.toLocalIterator():
        out[part["part"]] = np.frombuffer(part["bits"], np.uint8)
    return out.reshape(rows, -1)


def estimated_repeated(keys: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for row in range(len(sketch)):
        at = cells_of(keys, row, cells)
        found &= (sketch[row][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, rows: int = ROWS, cells: int = CELLS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one blank) of every whole text.

    A word goes if a window over it also starts in a document with a smaller id; windows are judged on the input.  Null
    texts have no words.  Rows with a null id keep all words and make no other document lose any.  Rows that repeat an
    id are not earlier than each other.  An empty table gives an empty table; columns besides the two are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs.where("doc_id is not null"), window, shingle, rows, cells))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            found, ids, places = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                words = Runs(text)
                at = np.flatnonzero(estimated_repeated(words.minimizers(window, shingle), sent.value, cells))
                if len(at):
                    found.append(np.stack([words.of(0, at, window), words.of(1, at, window)], axis=1).view(np.int64))
                    ids.append(np.full(len(at), doc, np.int64))
                    places.append((xxhash.xxh32_intdigest(text) >> 1 << 32) + at)  # the row of the id, and the word
            if found:
                both = np.concatenate(found)
                yield from pa.Table.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))],
                    ["h1", "h2", "doc_id", "place"],
                ).to_batches(max_chunksize=65536)

    windows = docs.where("doc_id is not null").mapInArrow(candidates, "h1 bigint, h2 bigint, doc_id bigint, place bigint")
    firsts = cut_and_clean(
        windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        .select("h1", "h2", "first"), "window-firsts",
    )
    removed = cut_and_clean(
        windows.join(firsts, ["h1", "h2"]).where("doc_id > first")
        .groupBy("doc_id", (F.shiftright("place", 32)).alias("row")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("at")),
        "window-places",  # as many places as the document has words
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            totals, gone, kept = [], [], []
            for text, at in zip(utf8(batch.column("text")), batch.column("at").to_pylist()):
                words = text.split()
                totals.append(len(words))
                if at:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, np.array(at) + window, -1)
                    left = np.cumsum(edges[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(left).tolist()]
                gone.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            row = [xxhash.xxh32_intdigest(t) >> 1 for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row, pa.int64())], ["doc_id", "text", "row"])

    marked = docs.mapInArrow(mark, "doc_id bigint, text string, row bigint")
    return marked.join(removed, ["doc_id", "row"], "left").select("doc_id", "text", "at").mapInArrow(
        keep, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )
