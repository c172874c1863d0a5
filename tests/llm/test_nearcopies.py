"""Near copies of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from quillspan.llm import nearcopies

STAGE = dict(corpus_pipeline.STAGES)["simhash_dedup"]


def brute_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_left(rows, least=0.8):
    """Rows that stay: null ids, and the least id of each component of pairs of ``least`` or more."""
    some = [r for r in rows if r[0] is not None]
    sets, group = [brute_set(r[1]) for r in some], list(range(len(some)))
    for i in range(len(some)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (len(a & b) / len(a | b) if a | b else 1.0) >= least:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min(r[0] for r, x in zip(some, group) if x == g) for g in group}
    return sorted([*(r[:2] for r in rows if r[0] is None), *(r[:2] for r, g in zip(some, group) if first[g] == r[0])], key=repr)


def edited(source, words, n):
    words = list(words)
    for k in source.sample(range(len(words)), n):
        words[k] = f"new{source.randrange(10**6)}"
    return words


def test_stage_equals_brute_force_jaccard(make, spark):
    source = random.Random(8)
    rows = [(None, "no id here"), (1, ""), (2, None), (3, "one"), (4, "One"), (5, "two words")]
    for family in range(30):  # one to six words changed: on both sides of 0.8
        base = [f"f{family}w{source.randrange(400)}" for _ in range(source.choice([40, 90, 150]))]
        rows += [(100 * (family + 1) + k, " ".join(edited(source, base, k))) for k in range(6)]
        rows.append((100 * (family + 1) + 50, " ".join(base[:30] + [f"inserted{k}" for k in range(6)] + base[30:])))
    chain = [f"c{k}" for k in range(100)]  # a window moves on: neighbours are alike, the ends are not
    rows += [(9000 - k, " ".join(f"c{x}" for x in range(4 * k, 4 * k + 100))) for k in range(8)]
    rows += [(9100, " ".join(chain[50:]))]
    got = sorted(((r["doc_id"], r["text"]) for r in STAGE(spark, make(rows), "").collect()), key=repr)
    assert got == brute_left(rows)
    assert 30 < len(got) < len(rows) - 60


def test_rows_that_share_an_id_are_told_apart(make, spark):
    text, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, text), (7, text + " more"), (7, other)]
    assert sorted((r["doc_id"], r["text"]) for r in STAGE(spark, make(rows), "").collect()) == [(1, text), (7, other)]


def test_crowded_bucket_makes_few_pairs_and_loses_no_link(make, spark, monkeypatch):
    """A passage that all texts hold puts them into common buckets; their own words tell most of them apart."""
    source, passage = random.Random(4), [f"p{k}" for k in range(40)]
    rows = [(k, " ".join(passage + [f"own{k}x{j}" for j in range(14)])) for k in range(60)]
    rows += [(1000 + k, rows[k][1].replace(f"own{k}x13", "other")) for k in range(0, 60, 7)]
    source.shuffle(rows)
    counts = []
    keep = nearcopies.open_pairs
    monkeypatch.setattr(nearcopies, "open_pairs", lambda *a: [f := keep(*a), counts.append(f.count())][0])
    got = sorted(((r["doc_id"], r["text"]) for r in STAGE(spark, make(rows), "").collect()), key=repr)
    assert got == brute_left(rows)
    assert sum(counts) < 60  # of 60 * 59 / 2 pairs that share a bucket


def test_dense_family_makes_few_pairs_and_loses_no_link(make, spark, monkeypatch):
    """Edits of one text that are too far apart: they share buckets and most shingles, and few of them are alike."""
    source, base = random.Random(12), [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(edited(source, base, source.choice([5, 6, 7])))) for k in range(120)]
    rows += [(1000 + k, rows[k][1].replace(" b", " c", 1)) for k in range(0, 120, 11)] + [(2000, " "), (2001, "b1")]
    counts = []
    keep = nearcopies.open_pairs
    monkeypatch.setattr(nearcopies, "open_pairs", lambda *a: [f := keep(*a), counts.append(f.count())][0])
    got = sorted(((r["doc_id"], r["text"]) for r in STAGE(spark, make(rows), "").collect()), key=repr)
    assert got == brute_left(rows)
    assert sum(counts) < 700  # of 120 * 119 / 2


def test_open_pairs_lose_no_alike_pair(make, spark):
    """One bucket of many texts with random edits, no component yet but what the pivot (the least node) makes."""
    source = random.Random(3)
    base = [f"w{source.randrange(90)}" for _ in range(110)]
    texts = [" ".join(edited(source, base[source.choice([0, 0, 3]):], source.randrange(6))) for _ in range(90)] + ["", "one two", "x " * 40]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    like = lambda a, b: nearcopies.similarity(sets[a], sets[b]) >= 0.8 - 1e-12
    label = [0 if like(0, k) else k for k in range(len(texts))]
    rows = spark.createDataFrame([(7, k, len(sets[k]), label[k]) for k in range(len(texts))], "key bigint, node bigint, n bigint, label bigint")
    given = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    got = {tuple(r) for r in nearcopies.open_pairs(rows, given, 0.8).collect()}
    want = {(a, b) for b in range(len(texts)) for a in range(b) if label[a] != label[b] and like(a, b)}
    assert want <= got and len(want) > 20


def test_stage_links_by_simhash(make, spark, monkeypatch):
    """Close copies are linked by fingerprints alone; a fingerprint's pair is still checked on both texts."""
    text = " ".join(f"a{k}" for k in range(60))
    monkeypatch.setattr(nearcopies, "bands", lambda hashes: [])
    assert [r["doc_id"] for r in STAGE(spark, make([(1, text), (2, text.upper())]), "").collect()] == [1]
    monkeypatch.setattr(nearcopies, "fingerprint", lambda text: 7)
    assert sorted(r["doc_id"] for r in STAGE(spark, make([(1, text), (2, text.upper()), (3, "of its own")]), "").collect()) == [1, 3]


def test_recall_of_bands_at_the_threshold():
    random_ = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):  # 80 of 100 shingles shared
        every = random_.integers(0, 2**63, 100).astype(np.uint64)
        a, b = np.sort(every[:90]), np.sort(every[10:])
        assert nearcopies.similarity(a, b) == 0.8
        missed += not set(nearcopies.bands(a)) & set(nearcopies.bands(b))
    assert missed <= 2
