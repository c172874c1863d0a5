from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quillspan.llm import quotient, simhash, windows
from quillspan.llm.components import components


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_exact_dedup_equals_brute_force(make, tidy):
    def norm(text):
        return re.sub(r"[\x20\x09-\x0D]", "", text or "")

    want = []
    for row in tidy:
        same = [r for r in tidy if norm(r[1]) == norm(row[1])]
        best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want.append((row[0], best[0], len(same), row[0] == best[0], hashlib.sha256(norm(row[1]).encode()).hexdigest()))
    assert rows_of(quotient.exact_dedup(make(tidy))) == sorted(want, key=repr)


def test_exact_dedup_of_empty_table(make):
    assert quotient.exact_dedup(make([])).count() == 0


def test_filters_merge_without_loss():
    merged = quotient.QuotientFilter.merge([
        quotient.QuotientFilter(4, 3, np.array([3 << 60, (3 << 60) + 9], np.uint64), np.array([1, 2])),
        quotient.QuotientFilter(4, 3, np.array([(3 << 60) + 9, (3 << 60) + 10], np.uint64), np.array([5, 1])),
    ])
    assert merged.fingerprints().tolist() == [3 << 60, (3 << 60) + 9, (3 << 60) + 10] and merged.counts.tolist() == [1, 7, 1]


def test_filter_bytes_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    for shard, data in quotient.partition_filters(np.concatenate([values, values[:100]]), 3):
        back = quotient.QuotientFilter.from_bytes(data)
        own = values[values >> np.uint64(61) == shard]
        assert (back.fingerprints() == own).all() and back.counts.sum() == len(own) + np.isin(values[:100], own).sum()


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(make, tidy):
    source = random.Random(3)
    base = [source.choice("abcdefghij") * source.randint(1, 4) for _ in range(120)]
    rows = list(tidy)
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[source.randrange(len(words))] = "zz"
        rows.append((100 + k, " ".join(words)))
    fps = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r[0])
    want = sorted(((r[0], f"{fps[k]:016x}", least.get(find(k))) for k, r in enumerate(rows)), key=repr)
    assert rows_of(simhash.near_duplicates(make(rows))) == want
    assert simhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("depth", [0, 3, 9])
def test_shards_lose_no_close_pair(depth):
    random_ = np.random.default_rng(4)
    centres = random_.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    near = [c ^ np.uint64(sum(1 << int(b) for b in random_.choice(64, n, replace=False))) for c in centres for n in range(7)]
    fps = np.unique(np.array([*near, 0, 2**64 - 1], dtype=np.uint64))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1:] if int(a ^ b).bit_count() <= 4}
    got = set()
    for block in range(3):
        rows, shards, home = simhash.route(fps, block, depth, 1)
        for shard in np.unique(shards):
            pick = shards == shard
            own, visitors = fps[rows[pick & home]], fps[rows[pick & ~home]]
            every = np.concatenate([own, visitors])
            for a, b in simhash.close_pairs(own, visitors, block, 4):
                got |= {(min(int(every[x]), int(every[y])), max(int(every[x]), int(every[y]))) for x, y in zip(a, b)}
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (-5, 300)]
    found = dict(rows_of(components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert found == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, -5: -5, 300: -5}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_windows(rows, size=13):
    split = [(r[0], [w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w]) for r in rows]
    first = {}
    for doc, words in split:
        for k in range(len(words) - size + 1):
            key = tuple(words[k:k + size])
            if doc is not None:
                first[key] = min(first.get(key, 1 << 60), doc)
    out = []
    for doc, words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if doc is not None and first[tuple(words[k:k + size])] < doc:
                gone |= set(range(k, k + size))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [1 << 10, 1 << 20])
def test_window_removal_equals_brute_force(make, tidy, cells):
    """A sketch of a thousand cells is full and passes everything; the rows are the same."""
    source = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = list(tidy)
    for doc in range(20, 60):
        words = [f"w{source.randrange(500)}" for _ in range(source.randint(0, 60))]
        a, n = source.randrange(30), source.randint(5, 30)
        rows.append((doc, " ".join(words[:20] + passage[a:a + n] + words[20:])))
    got = rows_of(windows.remove_repeated(make(rows), cells=cells))
    assert got == brute_windows(rows)


def test_window_removal_of_empty_table(make):
    assert windows.remove_repeated(make([]), cells=1 << 12).count() == 0
