from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.llm import langid, language_model, licenses, mixing, secrets
from quillspan.session import cut_lineage


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


LABELLED = [
    (100 + k, text, lang, "s")
    for k, (lang, text) in enumerate([
        ("en", "the cat and the dog are in the house with the children"), ("de", "der hund und die katze sind nicht in dem haus"),
        ("fr", "le chien et le chat sont dans la maison avec les enfants"), ("ru", "кошка и собака живут в доме вместе с детьми"),
    ] * 6)
]


def test_language_edges(make, tidy):
    model = langid.learn(make(LABELLED))
    got = {r["doc_id"]: r for r in langid.identify(make([*tidy, (20, "123 ²³ ..."), (21, "собака и дом")]), model).collect()}
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) == ("und", 0.0, []) for k in (1, 2, 3, 9, 20))
    assert got[21]["lang_pred"] == "ru" and got[4]["lang_pred"] in {"en", "de", "fr"} and 0 <= got[5]["score"] <= 1
    assert langid.identify(make([]), model).count() == 0


def test_mixed_text_falls_into_spans(make):
    model = langid.learn(make(LABELLED))
    text = "the dog and the cat are in the house der hund und die katze sind in dem haus кошка и собака"
    spans = [tuple(s) for s in langid.identify(make([(1, text)]), model).first()["spans"]]
    assert spans == [(0, 9, "en"), (9, 9, "de"), (18, 3, "ru")]


def test_viterbi_equals_brute_force(make):
    model = langid.learn(make(LABELLED))
    random = np.random.default_rng(2)
    pool = " ".join(r[1] for r in LABELLED[:4]).split() + ["zebra", "ось", "x"]
    texts = [" ".join(random.choice(pool, n)) for n in (1, 2, 3, 40, 7, 200, 11)] + [""]
    got = list(model.predict(texts))
    for text, (_, _, spans) in zip(texts, got):
        words = text.split()
        if not words:
            assert spans == []
            continue
        scores = model.word_scores(words).astype(np.float32)
        value, back = scores[0].copy(), []
        for s in scores[1:]:
            best = int(value.argmax())
            back.append([k if value[k] >= value[best] - model.penalty else best for k in range(len(value))])
            value = np.maximum(value, value[best] - model.penalty) + s
        path = [int(value.argmax())]
        for row in reversed(back):
            path.append(row[path[-1]])
        assert [model.languages.index(lang) for _, n, lang in spans for _ in range(n)] == path[::-1]


def test_no_labels_means_no_language(make, tidy):
    model = langid.learn(make(tidy))
    assert {r["lang_pred"] for r in langid.identify(make(tidy), model).collect()} == {"und"}
    assert langid.keep_identified(make(tidy), model).count() == 0


def test_keep_identified_keeps_all_columns(make):
    docs = make([*LABELLED, (1, None, "en"), (2, "12 34", "en")])
    kept = langid.keep_identified(docs, langid.learn(docs))
    assert kept.columns == docs.columns and kept.count() == len(LABELLED)


SECRETS = [
    (1, None), (2, ""), (3, 'Password: "hunter22" and token=abc'), (4, "secret=token:abcdefgh"), (5, "PASSWD = aaaaaa; api_key='k1k2k3k4'"),
    (6, "AKIA" + "Z9" * 8 + " AKIASHORT"), (7, "deadbeef" * 3 + " " + "ab" * 11), (8, "ſecret=abcdefg ünïcode token=abcdef1"), (None, "token=abcdef1"),
    (9, "-----BEGIN RSA PRIVATE KEY-----"), (10, "x" * 300000 + " token=abcdef1"), (3, 'Password: "hunter22" and token=abc'),
]


def brute_base(text):
    kinds = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24),
    }
    found = [
        (m.start(), n, m.end(), kind) for n, (kind, (pattern, group, least)) in enumerate(kinds.items())
        for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least
    ]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_secrets_equal_brute_force(make):
    findings, ledger = secrets.scan_versions(make(SECRETS))
    got = sorted(((r["path"], [tuple(s) for s in r["spans"] if s["kind"] in secrets.BASE]) for r in findings.collect()), key=repr)
    assert got == sorted(((r[0], brute_base(r[1])) for r in SECRETS), key=repr)
    assert ledger.count() == len({r[1] or "" for r in SECRETS})


def test_ledger_scans_only_unseen_blobs(make, spark):
    first, ledger = secrets.scan_versions(make([(1, "token=abcdef1"), (2, "plain")]))
    later = make([(1, "token=abcdef2"), (2, "plain"), (3, "token=abcdef1")])
    findings, new = secrets.scan_versions(later, ledger)
    assert new.count() == 1  # only the new text of path 1
    assert {r["path"]: len(r["spans"]) for r in findings.collect()} == {1: 1, 2: 0, 3: 1}
    _, again = secrets.scan_versions(later, ledger.unionByName(new))
    assert again.count() == 0
    _, other_rules = secrets.scan_versions(later, ledger.unionByName(new), rules="2")
    assert other_rules.count() == 3
    empty, none = secrets.scan_versions(make([]))
    assert empty.count() == 0 and none.count() == 0


def test_licenses_equal_sql(make, tidy):
    rows = [
        *tidy, (20, "x\nLicensed under the Apache License, Version 2.0.\nMIT License and the GENERAL public license"),
        (21, "licensed under the apache license version"), (22, "mit\nlicense"), (23, "Released under the MIT licence"),
        (24, "under the version 2 0 apache license licensed " * 3), (25, "mit licensemit license"), (26, "MIT KLicense mit licenſe"),
        (27, "Redistribution and use in source and binary forms with modification are permitted provided that the following conditions are"),
        (20, "another text with the same id: mit license"),
    ]
    docs = make(rows)
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    con.register("documents", documents)
    cursor = con.execute(licenses.brute_force_sql())
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    assert rows_of(licenses.scan_licenses(docs).select(names)) == want
    assert licenses.scan_licenses(make([])).count() == 0


def test_license_words_are_taken_once(make, monkeypatch):
    plans = []

    def plan(frame, name):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(frame, name)

    monkeypatch.setattr(licenses, "cut_lineage", plan, raising=False)
    global_order = licenses.global_order
    monkeypatch.setattr(licenses, "global_order", lambda frame, words: [
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString()), global_order(frame, words)][1])
    scanned = licenses.scan_licenses(make([(1, "mit license"), (2, "x\nReleased under the MIT License.")]))
    plans.append(scanned._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("regexp_extract_all(") for p in plans) == 1


def test_license_plan_is_native(make):
    plan = licenses.scan_licenses(make([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


MIXED = [(k, f"text {k}", None, source) for k, source in enumerate(["a"] * 400 + ["b"] * 100 + [None] * 20)]


def test_poisson_copies_follow_the_rates(make):
    docs = make(MIXED)
    want = {r["_mix_source"]: r["_mix_rate"] * n for r in mixing.rates(docs).collect() for n in [{"a": 400, "b": 100, None: 20}[r["_mix_source"]]]}
    mixed = mixing.mix(docs, total=5200).groupBy("source").count().collect()
    for r in mixed:
        mean = want[r["source"]] * 10
        assert abs(r["count"] - mean) < 5 * mean ** 0.5
    assert mixing.mix(docs).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_draws_equal_inverse_distribution(make):
    import hashlib
    import math

    rates = {r["_mix_source"]: r["_mix_rate"] for r in mixing.rates(make(MIXED)).collect()}
    got = {(r["doc_id"]): r["n"] for r in mixing.mix(make(MIXED)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for doc, _, _, source in MIXED:
        u, k, mean = int(hashlib.md5(f"{mixing.SEED}|1|{doc}".encode()).hexdigest()[:13], 16) / 2**52, 0, rates[source]
        below = math.exp(-mean)
        while below <= u:
            k += 1
            below += math.exp(-mean) * mean**k / math.factorial(k)
        assert got.get(doc, 0) == k


def test_mixing_targets_large_rates_and_edges(make, tidy):
    docs = make([(1, "x", None, "a"), (2, "y", None, "b"), (None, None, None, None)])
    counts = {r["source"]: r["count"] for r in mixing.mix(docs, targets={"a": 1.0}, total=3000).groupBy("source").count().collect()}
    assert set(counts) == {"a"} and abs(counts["a"] - 3000) < 300
    assert mixing.mix(docs, targets={}).count() == 0
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make(tidy)).count() > 0


def brute_base_scores(rows, learned):
    from collections import Counter

    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) + ["\n"] for r in rows]
    counts = Counter(t for r, ts in zip(rows, tokens) if learned(r[0]) for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [
        (r[0], len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6))
        for r, ts in zip(rows, tokens)
    ]


def test_language_model_base_and_edges(make, tidy):
    rows = [*tidy, *[(200 + k, "the cat sat on the mat and the dog ran off " * (k % 3 + 1)) for k in range(30)]]
    scored = language_model.score_documents(make(rows), ~(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2))
    learned = lambda doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2
    got = sorted(((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in scored.collect()), key=repr)
    want = sorted(brute_base_scores(rows, learned), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in scored.collect())


def test_language_model_without_training_rows(make):
    scored = language_model.score_documents(make([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scored} == {
        (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)
    }
    assert language_model.score_documents(make([]), F.lit(True)).count() == 0


def test_gradient_and_carried_state():
    counts = np.array([50, 30, 20, 10, 9, 8, 7])
    words = language_model.Vocabulary({b"\n": 0, **{b"w%d" % k: k for k in range(1, 7)}}, counts, 140, 9)
    language_model.classify(words, np.random.default_rng(0).random((7, 64)), classes=3)
    random = np.random.default_rng(1)
    network = language_model.Network(classes=3)
    network.start_from(words)
    network.vector += random.normal(0, 0.2, len(network.vector)).astype(np.float32)
    end = int(words.unit[0])
    docs = [words.unit[np.append(random.integers(1, 8, n), 0)] for n in (3, 70, 20)]
    together = network.documents(docs, end)
    apart = [network.documents([d], end)[0] for d in docs]  # lanes and windows do not change a document's score
    assert np.allclose(together, apart, rtol=1e-4)

    before = np.array([[end], [docs[1][0]], [docs[1][1]]])
    units, fresh = np.array([[u] for u in docs[1][:3]]), np.array([[True], [False], [False]])
    grad, mask, state = np.zeros_like(network.vector), np.ones((3, 1), np.float32), np.zeros((1, network.hidden), np.float32)
    network.window(before, units, fresh, state, mask, network.views(grad))
    for k in random.choice(np.flatnonzero(np.abs(grad) > 1e-3), 25, replace=False):
        old, sides = network.vector[k], []
        for step in (1e-2, -1e-2):
            network.vector[k] = old + step
            sides.append(-float(network.window(before, units, fresh, state, mask, None)[0].sum()))
        network.vector[k] = old
        assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(float(grad[k]), rel=0.05, abs=2e-3)
