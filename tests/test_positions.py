from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import chunks as CH
from quillspan.operators.positions import number_rows


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_is_numbered_by_many_tasks(spark, many_tasks):
    source = random.Random(3)
    rows = [("hot" if k % 3 else source.choice(["a", "b", None]), source.randint(0, 50), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o int, id long").repartition(5)
    got = number_rows(frame, ["g"], [F.desc("o"), F.col("id")]).collect()
    assert {r.id: r.place for r in got} == {
        r[2]: n for g in ("hot", "a", "b", None)
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    everywhere = number_rows(frame, [], [F.col("o"), F.col("id")], "rank").collect()
    assert [r.id for r in sorted(everywhere, key=lambda r: r["rank"])] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert number_rows(frame.limit(0), ["g"], [F.col("o")]).count() == 0


@pytest.mark.parametrize("slice_rows", [4, 7, 64, 4096])
def test_batches_do_not_depend_on_slices(spark, many_tasks, slice_rows):
    source = random.Random(7)
    rows = [(g, k, "x" * source.choice([1, 30, 200, 450, 900, 1799, 2500])) for g, n in (("hot", 700), ("b", 9), (None, 3)) for k in range(n)]
    got = CH.batch_texts(spark.createDataFrame(rows, "kind string, ord long, text string"), "kind", "ord", slice_rows=slice_rows).collect()
    want, state = {}, {}
    for g, k, text in rows:
        tokens = -(-(len(text) + 1) // 4)
        batch, count, chars, used = state.get(g, (0, 0, 0, 0))
        if count and (count >= 4 or chars + 1 + len(text) > 1800 or used + 4 + tokens > 520):
            batch, count, chars, used = batch + 1, 0, 0, 0
        state[g] = batch, count + 1, chars + (count > 0) + len(text), used + 4 * (count > 0) + tokens
        want[(g, k)] = batch
    found = {(r.kind, r.ord): r.batch_no for r in got}
    assert found == want
