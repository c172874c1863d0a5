"""Every stage of the pipeline on a small table, against what a plain loop keeps."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillspan.llm import mixing
from tests.llm.test_dedup import brute_fingerprint
from tests.llm.test_text_operators import LABELLED

STAGES = dict(corpus_pipeline.STAGES)


def texts_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def fixture():
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    near = [*words[:150], "changed", *words[151:]]
    clean = [(k, f"{text} number {chr(97 + k % 26)} {' '.join(words[k % 50:k % 50 + 30])}", lang, "s") for k, (_, text, lang, _) in enumerate(LABELLED)]
    return [
        *clean, (500, " ".join(words), "en", "t"), (501, "  ".join(words), "en", "t"), (502, " ".join(near), "en", None), (503, None, "en", "t"),
        (504, "123 456", "en", "t"), (500, " ".join(words), "en", "t"), (None, "a text without an id of its own", "en", "s"),
    ]


def test_stages_keep_what_a_loop_keeps(make, spark):
    rows = fixture()
    docs = make(rows)
    identified = STAGES["language_id"](spark, docs, "")
    assert identified.columns == docs.columns
    kept = [r for r in rows if re.search("[a-z]", r[1] or "")]
    assert texts_of(identified) == sorted(((r[0], r[1]) for r in kept), key=repr)

    single = STAGES["exact_dedup"](spark, identified, "")
    assert single.columns == docs.columns
    best = {}
    for r in kept:
        name = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if name not in best or (-len(r[1]), r[0] is None, r[0]) < (-len(best[name][1]), best[name][0] is None, best[name][0]):
            best[name] = r
    assert texts_of(single) == sorted(((r[0], r[1]) for r in best.values()), key=repr)

    apart = STAGES["simhash_dedup"](spark, single, "")
    assert apart.columns == docs.columns
    left = []
    groups = []
    for r in sorted((r for r in best.values() if r[0] is not None), key=lambda r: r[0]):
        fp = brute_fingerprint(r[1])
        near = [g for g in groups if any((fp ^ f).bit_count() <= 4 for f, _ in g)]
        merged = [(fp, r), *(m for g in near for m in g)]
        groups = [g for g in groups if g not in near] + [merged]
    left = [min((r for _, r in g), key=lambda r: r[0]) for g in groups] + [r for r in best.values() if r[0] is None]
    assert texts_of(apart) == sorted(((r[0], r[1]) for r in left), key=repr)

    mixed = STAGES["mix_sources"](spark, apart, "")
    assert mixed.columns == docs.columns
    drawn = Counter(r["doc_id"] for r in mixing.mix(apart).select("doc_id").collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == drawn

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = STAGES["bpe_encode"](spark, mixed, "").collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(encoded) == sum(drawn.values())
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in encoded)


def test_run_over_files_and_empty_tables(make, spark, tmp_path):
    make(fixture()).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mix_sources", "bpe_encode"]
