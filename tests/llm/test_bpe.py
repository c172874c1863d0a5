from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_rows_equal_the_library(make, tidy, library):
    encoded = bpe.encode(make(tidy), PATH)
    rows = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.decode(encoded, PATH).collect()), key=repr)
    want = []
    for row in tidy:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert rows == sorted(want, key=repr)


def test_empty_table(make):
    assert bpe.encode(make([]), PATH).count() == 0


def test_random_texts_equal_the_library(library):
    model, source = bpe.load(PATH), random.Random(5)
    pool = [chr(c) for c in range(1, 0x3000)] + ["<|endoftext|>", "  ", "'s", "\n", "\r\n", " 1", "ⅷ", "౜", "🙂"] * 100 + list("abcdeint  ") * 300
    for _ in range(1500):
        text = "".join(source.choice(pool) for _ in range(source.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text).tolist() == ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_very_long_pieces(library):
    model = bpe.load(PATH)
    for text in ("a" * 30000, "ab" * 20000, "x1" * 5000 + " " * 5000, "é" * 10000):
        assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_limits_do_not_change_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    model = bpe.ByteBPE(PATH)
    text = "The quick brown fox jumps over the lazy dog; the quick brown fox sleeps. " * 5
    assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_bytes_and_nulls(spark):
    model = bpe.load(PATH)
    half = model.encode("漢").tolist()[:1]
    frame = spark.createDataFrame([(1, half), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(frame, PATH).collect()} == {1: "�", 2: "", 3: ""}
