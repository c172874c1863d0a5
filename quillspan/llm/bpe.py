"""Byte-level BPE by dynamic programming over prefixes.

The BPE result of every prefix of a piece has one last token.  It is, of the vocabulary tokens that end the prefix, the
one that stays whole next to the last token of the shorter prefix.  So a piece is encoded in one pass: an automaton over
the vocabulary gives the tokens that end at each byte, a compatibility test of two neighbouring tokens picks the one,
and back-pointers from the end give the ids.  Work is linear in the length of a piece, however long it is.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from quillspan.llm.common import id_and_text, small

# White space, letters and digits as the library of the vocabulary reads them.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and digits of Unicode 17, which that library does not know yet.
UNKNOWN = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 "
    "\uab6c-\uab6d \U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a "
    "\U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda "
    "\U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 "
    "\U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff "
    "\U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 "
    "\U0003d000-\U0003fc3f"
).replace(" ", "")
LETTER, DIGIT = rf"[\p{{L}}--[{UNKNOWN}]]", rf"[\p{{N}}--[{UNKNOWN}]]"
# The same for the first 256 characters, for texts that hold no others.
LATIN_LETTER, LATIN_DIGIT, LATIN_SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r \x85\xa0"


def split_pattern(letters: str, digits: str, others: str, space: str) -> str:
    """Fixed value: how byte-level BPE cuts a text into pieces."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?{others}+|[{space}]+(?![^{space}])|[{space}]+"
    )


PATTERN = split_pattern(LETTER, DIGIT, rf"[[^{SPACE}]--\p{{L}}--\p{{N}}||[{UNKNOWN}]]", SPACE)
KNOWN_PATTERN = split_pattern(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]", SPACE)
LATIN_PATTERN = split_pattern(
    f"[{LATIN_LETTER}]", f"[{LATIN_DIGIT}]", f"[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_DIGIT}]", LATIN_SPACE
)
#: Entries that a worker keeps of pieces (in each of two generations) and of token pairs; results do not depend on them.
PIECES_KEPT = 400_000
PAIRS_KEPT = 600_000
#: Longer pieces are not kept.
PIECE_BYTES_KEPT = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by character."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level vocabulary read from a tokenizer file, with exact encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, model = byte_alphabet(), spec["model"]
        as_bytes = lambda shown: bytes(alphabet[c] for c in shown)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added_split = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")"
        ) if self.added else None
        ids = {as_bytes(t): k for t, k in model["vocab"].items() if t not in self.added}
        self.token_bytes = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, k in ids.items():
            self.token_bytes[k] = token
        for token, k in self.added.items():
            self.token_bytes[k] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for order, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            pair = (ids[a], ids[b])
            if pair not in self.rank:
                self.rank[pair] = order
                made.setdefault(ids[a + b], (order, *pair))
        self.rising = {k: self._spine(k, made, 2) for k in ids.values()}
        self.falling = {k: self._spine(k, made, 1) for k in ids.values()}
        self.automaton = ahocorasick.Automaton()
        for token, k in ids.items():
            if len(token) == 1 or k in made:  # a token that no merge makes is never a result
                self.automaton.add_word(token.decode("latin-1"), (len(token), k))
        self.automaton.make_automaton()
        self.split_known, self.split_any = (regex.compile(p, regex.V1).findall for p in (KNOWN_PATTERN, PATTERN))
        self.split_latin, self.newer = re.compile(LATIN_PATTERN).findall, re.compile(f"[{UNKNOWN}]").search
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of ``token`` as it grows from its first byte, each with the rank that ends it."""
        chain, end = [], float("inf")
        while True:
            chain.append((token, end))
            if token not in made:
                return chain[::-1]
            end, token = made[token][0], made[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side stay two tokens.

        Both grow from bytes in the order of merge ranks; they stay apart unless, at some time, the two tokens at the
        border form a pair that merges before either grows on (of equal ranks the left-most pair goes first).
        """
        a, b, i, j, apart = self.rising[left], self.falling[right], 0, 0, True
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_end and across <= y_end:
                apart = False
                break
            if x_end <= y_end:
                if i + 1 == len(a):
                    break
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[(left, right)] = apart
        return apart

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text) if self.newer(text) else self.split_known(text)
        return self.split_latin(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: last tokens of all prefixes, then the way back."""
        last, size, done = [-1] * len(piece), [0] * len(piece), -1
        known, compatible = self.pairs.get, self.compatible
        for at, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if at == done:
                continue  # this prefix has its one last token
            if length <= at:
                pair = (last[at - length], token)
                apart = known(pair)
                if not (compatible(*pair) if apart is None else apart):
                    continue
            last[at], size[at], done = token, length, at
        ids, at = [], len(piece) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens become their own ids."""
        if self.added_split is None or not self.added_split.search(text):
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), dtype="<u4")
        parts = []
        for k, part in enumerate(self.added_split.split(text)):
            if k % 2:
                parts.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                parts.extend(map(self.pieces.__getitem__, self.split(part)))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


class Pieces(dict):
    """Piece -> its ids as bytes, filled on demand; of two generations the older one goes when the younger is full."""

    def __init__(self, model: ByteBPE):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("I", self.model.encode_piece(raw)).tobytes()
            if len(raw) > PIECE_BYTES_KEPT:
                return ids
        if len(self) >= PIECES_KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, decoded: bool = False
) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every whole text.

    ``packed``: also ``packed``, the ids as little-endian unsigned 32-bit integers, and ``n_tokens`` in place of ``ids``.
    ``decoded``: also ``decoded``, the text of the ids.  Null and empty texts give no ids; null ids and repeated rows stay
    as rows of their own; an empty table gives an empty table.  Columns besides the two are not read.  ``tokenizer`` is a
    file that every executor can open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memory of pieces holds no cycles, and walking it again and again takes a third of the time
        model = load(tokenizer)
        for batch in small(batches):
            found = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id")}
            if packed:
                out["n_tokens"] = pa.array(list(map(len, found)), pa.int64())
                out["packed"] = pa.array([f.tobytes() for f in found], pa.binary())
            else:
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(offsets, pa.array(flat))
            if decoded:
                out["decoded"] = pa.array([model.decode(f.tolist()) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    ids = "n_tokens bigint, packed binary" if packed else "ids array<int>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, {ids}" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` and the text of its ids as ``out_col``; null ids give the empty text, bytes that are no UTF-8 U+FFFD."""
    fields = [f for f in encoded.schema.fields if f.name != out_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in small(batches):
            texts = [model.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, out_col])

    return encoded.mapInArrow(run, StructType([*fields, StructField(out_col, StringType())]))
