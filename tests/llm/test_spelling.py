from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edits(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def neighbours(words):
    """Near pairs by brute force over words that share what is left when a letter is taken out or is open."""
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for some in holes.values():
        for a in some:
            near[a].update(b for b in some if edits(a, b))
    return near


def contract(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(rows, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found, want = rows(queries.QUERIES["op12_spelling_variants"](spark, sf_dir)), contract(docs)
    assert found == want
    assert sum(r[1] is not None for r in want) >= 10


def test_odd_texts(spark, make, tidy):
    extra = [(20, "Überfülle ÜBERFÜLLE überfülle×÷ÿß naïveté naïveté"), (21, "abcdefg abcdefg " * 40 + "abcdefx abcdefx abcdeffg abcdeffg bcdefgh bcdefgh")]
    docs = [*((r[0], r[1]) for r in tidy), *extra, *[(k, "letters letters lettters leters lletters") for k in range(40)]]
    assert rows(spelling.group_variants(make(docs))) == contract(docs)


def test_chains_of_forms(spark, make):
    docs = [(k, f"{'aaaaaaa ' * 4000}{'aaaaaab ' * 200}{'aaaaabb ' * 12}aaaabbb") for k in range(40)]
    found = rows(spelling.group_variants(make(docs)))
    assert found == contract(docs)
    assert {r[0]: r[2] for r in found}["aaaabbb"] == "aaaaaaa"


def test_empty_table(make):
    assert spelling.group_variants(make([])).count() == 0


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abc", 2), ("abcdefghé", 3)])
def test_search_of_every_part_equals_brute_force(letters, seed):
    """Any part of the query may hold the edit, from either side; runs of one letter make an edit ambiguous."""
    source = random.Random(seed)
    words = sorted({"".join(source.choice(letters) for _ in range(source.randint(3, 9))) for _ in range(400)})
    near = neighbours(words)
    for parts in (1, 2, 3, 4):
        asked, low, high = [], [], []
        for w in words:
            for k in range(parts):
                a, b = len(w) * k // parts, len(w) * (k + 1) // parts
                if b > a:
                    asked.append(w)
                    low.append(a)
                    high.append(b)
        q, t = spelling.near_words(words, asked, np.array(low), np.array(high))
        found = Counter((asked[i], words[j]) for i, j in zip(q, t))
        assert set(found.values()) == {1} and set(found) == {(a, b) for a in near for b in near[a]}


@pytest.mark.parametrize("shard, most", [(64, 4), (500, 40), (24000, 6000)])
def test_crowded_groups_are_split_without_loss(spark, shard, most):
    """A third of the vocabulary shares its first letters, another third its last ones."""
    source = random.Random(9)
    tail = lambda k: "".join(source.choice("abcde") for _ in range(k))
    words = {f"prefixes{tail(4)}" for _ in range(250)} | {f"{tail(4)}suffixes" for _ in range(250)} | {tail(8) for _ in range(200)}
    n = {w: source.randint(2, 90) for w in words}
    near = neighbours(words)
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_counts(frame, shard, most).collect()}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in words if near[w]}
    assert found == {w: (len(near[w]), b, n[b]) for w, b in best.items()}


def test_counts_do_not_depend_on_flushes(spark, make, monkeypatch):
    docs = make([(k, "variants of spelling variants") for k in range(50)])
    want = rows(spelling.vocabulary(docs).groupBy().agg(F.sum("n"), F.count("*")))
    monkeypatch.setattr(spelling, "COUNTED_AT_ONCE", 1)
    assert rows(spelling.vocabulary(docs).groupBy().agg(F.sum("n"), F.count("*"))) == want
