"""Chunks of a text in one pass: blocks, cuts of long blocks, packing, and block vectors on the way.

A text sits in one row, so nothing is exchanged between text and chunks.  ``blocks.split_blocks`` says the same as windows
over lines; tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from quillspan import constants as K
from quillspan.functions import budgets as B
from quillspan.operators.blocks import BLOCK_LIMIT
from quillspan.operators.embed import embed_tokens
from quillspan.operators.frames import few_rows
from quillspan.operators.packing import normalize, pack_blocks, split_text

MADE = "blocks_n int, profile_label string, chunks array<struct<text:string,embedding:array<float>>>"
_MADE = pa.schema([
    ("blocks_n", pa.int32()), ("profile_label", pa.string()),
    ("chunks", pa.list_(pa.struct([("text", pa.string()), ("embedding", pa.list_(pa.float32()))]))),
])
#: Texts whose chunks a worker holds at once.
ROWS_AT_ONCE = 64


def _pattern(*sources: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{s.replace('(?i)', '(?i:') + ')' if '(?i)' in s else s})" for s in sources).replace(r"\z", r"\Z"), re.ASCII)


_HEADING = _pattern(K.RE_NUMBERED_HEADING, K.RE_TITLED_HEADING)
_BULLET = _pattern(K.RE_BULLET)
_LEAD = _pattern(K.RE_LEAD_NUMBERED, K.RE_LEAD_IMPERATIVE, K.RE_LEAD_STEP)
_CODE_MARKS = ("::", "=>", "{", "}", "=")
_TOKEN = re.compile(r"[a-z0-9.+_-]+")


class Line:
    """A line that belongs to a block, with what the lines around it need to know."""

    __slots__ = ("shown", "fence", "inside", "heading", "structured", "lead", "procedural", "cut", "starts")

    def __init__(self, raw: str, line: str, fence: bool, inside: bool):
        code = bool(line) and (raw.startswith(("    ", "\t")) or line.startswith(("$", "#")) or any(m in line for m in _CODE_MARKS))
        marker = _is_marker(line)
        self.shown, self.fence, self.inside = raw, fence, inside
        self.heading = not inside and not fence and (line.startswith("#") or bool(_HEADING.search(line)))
        self.structured = bool(_BULLET.search(line)) or code
        self.lead = bool(line) and not marker and bool(_LEAD.search(line))
        self.procedural = self.lead or code
        self.cut = self.starts = False


def _is_marker(line: str) -> bool:
    return line.startswith("[[PAGE ") and line.endswith("]]")


def _gaps(text: str) -> Iterator[tuple[str | None, bool, bool, Line | None]]:
    """(last page marker, a blank line came before the first marker, a marker came, the line) for each line with content;
    a text that ends with a marker gives a last row without a line."""
    inside, marker, blank_first, paged = False, None, False, False
    for raw in text.split("\n"):
        line = raw.strip(K.WS_CHARS)
        is_marker = _is_marker(line)
        fence = not is_marker and line.startswith(("```", "~~~"))
        if not is_marker and (inside or line):
            yield marker, blank_first, paged, Line(raw, line, fence, inside)
            marker, blank_first, paged = None, False, False
        elif is_marker:
            marker, paged = line, True
        elif not paged:
            blank_first = True
        inside ^= fence
    if marker is not None:
        yield marker, blank_first, paged, None


def segments(text: str) -> list[tuple[str, bool]]:
    """(block, is heading) in order; the rules are those of ``blocks.split_blocks``."""
    lines: list[Line] = []
    for marker, blank_first, paged, line in _gaps(text):
        one, two, three = ([None, None, None, *lines][-k] for k in (1, 2, 3))
        trailing = line is None
        if trailing:
            line = Line(marker, marker, False, False)
            line.heading = False
        elif marker is not None and not line.inside:
            line.shown = f"{marker}\n{line.shown}"
        fresh = line.structured and one is not None and not one.structured and not one.lead and not line.inside and not line.fence
        line.cut = bool(
            (line.fence and not line.inside) or line.heading or (one and one.heading) or (one and one.fence and one.inside)
            or blank_first or trailing or fresh)
        recent = one is not None and (one.procedural or not one.cut and two is not None and (
            two.procedural or not two.cut and three is not None and three.procedural))
        line.starts = line.cut or paged and not line.inside and not recent
        lines.append(line)
    number, numbered = 0, []
    for line in lines:
        number += line.starts
        numbered.append((number, line))
    out = []
    for _, run in groupby(numbered, key=lambda item: item[0]):
        members = [line for _, line in run]
        block = normalize("\n".join(line.shown for line in members))
        if block:
            out.append((block, any(line.heading for line in members)))
    return out


def text_blocks(text: str, limit: int = BLOCK_LIMIT) -> list[str]:
    """The blocks of a text, those over ``limit`` cut; headings stay whole."""
    out = []
    for block, heading in segments(text):
        out += [block] if heading or len(block) <= limit else split_text(block, limit)
    return out


def surface_tokens(text: str) -> list[str]:
    """What ``terms.embedding_tokens`` makes of a text."""
    raw, out = _TOKEN.findall(text.lower()), []
    for token, following in zip(raw, [*raw[1:], ""]):
        if len(token) >= 2:
            out += [token, *K.EMBED_SYNONYMS.get(token, [])]
            if len(token) >= 5:
                out += [token[j:j + 3] for j in range(len(token) - 2)]
            if len(following) >= 2:
                out.append(f"{token}_{following}")
    return out


def chunk_texts(files: DataFrame, semantic: bool = False, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``blocks_n``, ``profile_label`` and ``chunks`` to files (source_type, size_bytes, text).

    With ``semantic`` blocks get hash vectors: a block unlike the chunk so far starts a new one, and a chunk's vector is
    the sum of its blocks' vectors.  A worker holds the chunks of ``ROWS_AT_ONCE`` texts, however many rows a batch has.
    """
    # the profile depends on whether there are many blocks, which is known in the row only
    profiles = [B.chunking_profile(F.col("source_type"), F.col("size_bytes"), F.lit(semantic), F.lit(n)) for n in (0, K.MANY_BLOCKS)]
    kept = [c for c in files.columns if keep_text or c != text]
    sent = files.select(*kept, F.struct(F.col(text).alias("text"), profiles[0].alias("few"), profiles[1].alias("many")).alias("_in"))
    schema = StructType([*(StructField(c, files.schema[c].dataType) for c in kept), *StructType.fromDDL(MADE).fields])

    def packed(row: dict) -> dict:
        blocks = text_blocks(row["text"] or "")
        profile = row["many"] if len(blocks) >= K.MANY_BLOCKS else row["few"]
        vectors = [embed_tokens(surface_tokens(b)).tolist() for b in blocks] if semantic else None
        chunks = pack_blocks(
            blocks, int(profile["target_chars"]), int(profile["minimum_chars"]), int(profile["hard_chars"]), int(profile["overlap_chars"]), vectors)
        return {"blocks_n": len(blocks), "profile_label": profile["label"], "chunks": [{"text": t, "embedding": v} for t, v in chunks]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, ROWS_AT_ONCE):
            rows = pa.RecordBatch.from_pylist([packed(row) for row in batch.column("_in").to_pylist()], _MADE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *rows.columns], [*kept, *_MADE.names])

    return sent.mapInArrow(run, schema)
