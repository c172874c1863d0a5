"""Token counts and hash vectors made in the row, against the column functions and plain loops."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quillspan.functions import terms as TM
from quillspan.operators import embed as EM

ROWS = [
    (1, "Deploy the vpn: Deploy controllers, a b upgrade-plan.v2 deploy the"), (2, ""), (3, None), (4, "x y z"), (5, "K\u0130R \u212Aelvin aaaa aaaa"),
    (6, "same key here"), (6, "Same Key there again"), (None, "no key of its own"), (None, "no key"), (7, "long" * 30 + " tail"),
]


def expected(rows):
    out = Counter()
    for key, tokens in rows:
        out.update((key, t) for t in tokens or ())
    return out


def test_frequencies_and_buckets_equal_the_column_function(spark):
    docs = spark.createDataFrame(ROWS, "k long, text string")
    tokens = expected(docs.select("k", TM.embedding_tokens(F.col("text")).alias("t")).collect())
    got = EM.token_frequencies(docs, ["k"])
    assert {(r.k, r.token): r.freq for r in got.collect()} == dict(tokens) and got.count() == len(tokens)
    frame = spark.createDataFrame([(k, t, n) for (k, t), n in tokens.items()], "k long, token string, freq long")
    want = {(r.k, r.bucket): r.weight for r in EM._bucket_sums(frame, ["k"], 192).collect()}
    made = {(r.k, r.bucket): r.weight for r in EM.hash_buckets(docs, ["k"]).collect()}
    assert made.keys() == want.keys() and all(abs(made[p] - want[p]) < 1e-9 for p in want)


def test_tokens_of_a_key_with_one_row_are_not_exchanged(spark):
    docs = spark.createDataFrame(ROWS, "k long, text string")
    before = EM._by_key(docs, ["k"], "text")
    assert [r.k for r in before[0].orderBy("k").collect()] == [1, 2, 3, 4, 5, 7] and before[1].count() == 4
    plan = EM.token_frequencies(docs, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "generate" not in plan.lower()


def test_vectors_equal_the_token_lists(spark):
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(ROWS)], "n long, text string")
    lists = {r.n: r.t for r in docs.select("n", TM.embedding_tokens(F.col("text")).alias("t")).collect()}
    for r in EM.hash_embed(docs, ["n"]).collect():
        assert abs(EM.embed_tokens(lists[r.n]) - r.embedding).max() < 1e-6 and len(r.embedding) == 192
