"""Operators on small fixtures against brute force and hand-worked rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.functions import policy as P, terms as TM, text as T
from quillspan.operators import blocks as BL, chunks as CH, manifest as MF, outline as O, search as SE, search_index as SI
from quillspan.plans import index as IX, study as ST
from quillspan.sources import corpus as CP
from quillspan.streaming import batch as BT, jobs, rules


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def test_blocks_with_page_markers(spark):
    text = "\n".join([
        "[[PAGE 1]]", "First line of prose", "second line", "[[PAGE 2]]", "", "run the tool:", "[[PAGE 3]]", "", "  ",
        "    cmd = 1", "", "1. Title here", "[[PAGE 4]]", "2. Other title", "```", "a", "", "b", "```", "after", "- item", "[[PAGE 5]]",
    ])
    blocks = BL.split_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [b for _, b in rows(blocks, "block_no", "block")]
    assert got == [
        "[[PAGE 1]]\nFirst line of prose\nsecond line", "[[PAGE 2]]\nrun the tool:\n[[PAGE 3]]\n    cmd = 1", "1. Title here",
        "[[PAGE 4]]\n2. Other title", "```\na\n\nb\n```", "after", "- item", "[[PAGE 5]]",
    ]


def test_block_lines_are_preserved(spark, sf_dir):
    from quillspan.catalog import derived as D

    docs = D.frame(spark, sf_dir, D.shaped)
    def count(frame, column):
        return frame.agg(F.sum(F.length(F.regexp_replace(column, r"\s+", ""))).alias("n")).first().n

    assert count(BL.split_blocks(docs), "block") == count(docs, "text")


def _sequential(wanted, taken=()):
    used, out = set(taken), []
    for path in wanted:
        name, n = path, 0
        while name in used:
            n += 1
            stem, _, ext = path.rpartition(".")
            name = f"{stem}_{n}.{ext}"
        used.add(name)
        out.append(name)
    return out


def test_unique_paths_equals_one_by_one(spark):
    rng = random.Random(7)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b.md"]
    wanted = [rng.choice(names) for _ in range(40)]
    frame = spark.createDataFrame([("c", i, w) for i, w in enumerate(wanted)], "collection_id string, ord int, relative_path string")
    taken = spark.createDataFrame([("c", "a_3.txt")], "collection_id string, relative_path string")
    got = [r[1] for r in rows(MF.unique_paths(frame, taken=taken), "ord", "unique_path")]
    assert got == _sequential(wanted, ["a_3.txt"])


def _brute_lexical(text, name, terms, query):
    def count(s, t):
        return sum(s.startswith(t, i) for i in range(len(s)))

    lower, lname, score, matched = text.lower(), name.lower(), 0.0, 0
    for t in terms:
        b, f = count(lower, t), count(lname, t)
        matched += bool(b or f)
        score += (0.95 + min(1.25, 0.16 * (b - 1)) if b else 0) + (0.55 + min(0.75, 0.18 * (f - 1)) if f else 0)
    whole = query.lower().strip()
    return score + 1.8 * matched / len(terms) + (1.2 if whole in lower else 0) + (0.75 if whole in lname else 0)


def test_lexical_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(SI, "QUERIES_PER_TASK", 2)  # several slices of queries
    monkeypatch.setattr(SI, "QUERIES_AT_ONCE", 1)
    texts = ["aaaa deploy the runbook", "Install INSTALL bootstrap aa", "nothing here", "error in pod aaa", "deploy runbook now"]
    chunks = spark.createDataFrame([(f"p{i % 2}", i, f"file_aa{i}.txt", "doc", "log", t) for i, t in enumerate(texts)],
                                   "path string, chunk_index int, file_name string, source_type string, source_role string, text string")
    asked = {1: "deploy runbook", 2: "aa", 3: "pod error", 4: "the and"}
    queries = SE.prepare_queries(spark.createDataFrame(list(asked.items()), "query_id int, query string"))
    terms = {r.query_id: r.terms for r in queries.collect()}
    got = {(q, i): round(s, 9) for q, i, s in rows(SE.lexical_pairs(chunks, queries), "query_id", "chunk_index", "lexical")}
    want = {}
    for q, query in asked.items():
        for i, t in enumerate(texts):
            score = _brute_lexical(t, f"file_aa{i}.txt", terms[q], query) if terms[q] else 0
            if score > 0:
                want[q, i] = round(score, 9)
    assert got == want


def test_one_file_with_most_chunks_keeps_its_cap(spark):
    data = [("hot.txt", i, "alpha beta") for i in range(300)] + [("cold.txt", i, "alpha beta") for i in range(3)]
    chunks = spark.createDataFrame(data, "path string, chunk_index int, text string").select(
        "*", F.col("path").alias("file_name"), F.lit("doc").alias("source_type"), F.lit("reference").alias("source_role"))
    hits = SE.hybrid_search(chunks, spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 8, detail=False)
    assert rows(hits, "rank", "path", "chunk_index") == [(i + 1, "cold.txt", i) for i in range(3)] + [(i + 4, "hot.txt", i) for i in range(5)]
    wide = SE.hybrid_search(chunks, spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 20, detail=False)
    assert [r[0] for r in rows(wide, "path")].count("hot.txt") == 6


def test_vector_topk_in_slices_equals_one_slice(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    probes = vectors.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    whole = rows(SE.vector_topk(vectors, probes, 5), "query_id", "item_id", "rank")
    monkeypatch.setattr(SE, "VECTOR_BATCH_CELLS", 64 * 7)
    assert rows(SE.vector_topk(vectors, probes, 5), "query_id", "item_id", "rank") == whole and len(whole) == 100


def test_merged_ranges_are_disjoint_and_cover(spark):
    rng = random.Random(3)
    spans = [(d, s, s + rng.randint(0, 4)) for d in range(4) for s in (rng.randint(0, 60) for _ in range(15))]
    merged = rows(O.merge_ranges(spark.createDataFrame(spans, "doc_id int, start_pos int, end_pos int")), "doc_id", "start_pos", "end_pos")
    for d in range(4):
        mine = [(a, b) for k, a, b in merged if k == d]
        assert all(b + 1 < c for (_, b), (c, _) in zip(mine, mine[1:]))
        assert {x for k, a, b in spans if k == d for x in range(a, b + 1)} == {x for a, b in mine for x in range(a, b + 1)}


def test_anchor_ties_take_the_later_chunk(spark):
    heads = spark.createDataFrame([(1, 1, "1. Setup", "1. setup")], "doc_id int, ord int, heading string, outline_key string")
    chunks = spark.createDataFrame([(1, 0, "about setup"), (1, 1, "about setup"), (1, 2, "none")], "doc_id int, pos int, text string")
    assert rows(O.anchor_headings(heads, chunks), "heading", "chunk_pos", "anchor_score") == [("1. Setup", 1, 4)]


def test_redaction_is_idempotent_on_its_words(spark):
    text = "see 10.0.0.1, a.b@example.org https://x.example/p?q=1 deadbeefdeadbeef01 " + "Z" * 30
    once = spark.range(1).select(P.redact(F.lit(text)).alias("t")).first().t
    assert once == "see [REDACTED] , [REDACTED] [REDACTED] [REDACTED] [REDACTED]"
    assert spark.range(1).select(P.redact(F.lit(once)).alias("t")).first().t == once


def test_query_terms_order_and_expansion(spark):
    got = spark.range(1).select(TM.query_terms(F.lit("Deploy the runbook, deploy MOP k8s x")).alias("t")).first().t
    assert got == ["deploy", "deployment", "install", "bootstrap", "runbook", "mop", "playbook", "procedure", "k8s", "kubernetes"]


def test_scan_and_read_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_text("hello\tworld  \r\n\r\n\r\n\r\n\r\nend")
    (tmp_path / "sub" / "b.log").write_bytes(b"bin\x00ary")
    (tmp_path / ".kb_manifest.json").write_text("{}")
    (tmp_path / "c.exe").write_text("no")
    files = CP.read_text(CP.scan_corpus(spark, str(tmp_path)))
    assert rows(files, "file_name", "extractor", "text") == [
        ("a.MD", "direct", "hello    world\n\n\nend"), ("b.log", "binary-skipped", "")]


def test_index_and_refresh(spark):
    body = " ".join(f"word{i}" for i in range(120))
    def files(texts, stamp):
        return spark.createDataFrame(
            [(f"kb/{n}", n, len(t), stamp.get(n, 1), "direct", t) for n, t in texts.items()],
            "path string, file_name string, size_bytes int, modified_ms int, extractor string, text string",
        ).withColumn("content_hash", F.sha1(F.encode("text", "UTF-8")))

    first = files({"a.txt": body, "b.txt": "tiny", "c.txt": body + " c"}, {})
    built = IX.index_corpus(first)
    counts = {r.path: (r.chunk_count, r.zero_chunk_reason) for r in built.sources.collect()}
    assert counts == {"kb/a.txt": (1, ""), "kb/b.txt": (0, "all-filtered"), "kb/c.txt": (1, "")}
    second = files({"a.txt": body, "c.txt": body + " changed", "d.txt": body + " d"}, {"a.txt": 9})
    after = IX.refresh_index(second, built.sources, built.chunks)
    assert [r[0] for r in rows(after.chunks, "path")] == ["kb/a.txt", "kb/c.txt", "kb/d.txt"]
    assert {r.path: r.modified_ms for r in after.sources.collect()} == {"kb/a.txt": 9, "kb/c.txt": 1, "kb/d.txt": 1}


def test_batches_respect_budgets(spark):
    texts = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate([900, 800, 400, 10, 10, 10, 10, 1700, 200])],
                                  "grp string, ord long, text string")
    got = [b for _, b in rows(CH.batch_texts(texts, "grp", "ord"), "ord", "batch_no")]
    assert got == [0, 0, 1, 1, 1, 1, 2, 2, 3]


def test_extraction_packet_of_small_and_large_files(spark):
    data = [("small", i, "alpha " * 20) for i in range(3)] + [("big", i, f"chunk {i} " + "text " * 200) for i in range(60)]
    chunks = spark.createDataFrame(data, "path string, pos int, text string").select(
        "*", F.col("pos").alias("chunk_index"), F.col("path").alias("file_name"), F.lit("reference").alias("source_role"),
        F.lit("doc").alias("source_type"))
    hits = spark.createDataFrame([("big", 30)], "path string, chunk_index int")
    packets = dict(rows(ST.extraction_packets(chunks, hits, 16000), "path", "packet"))
    assert "--- FULL_FILE (budget-trimmed) ---" in packets["small"]
    assert packets["big"].count("--- RAW_CHUNK_RANGE ") >= 1 and len(packets["big"]) <= 16000 + 600


def test_stream_rules_equal_batch_twins(spark):
    lines = ["Alpha line one", "Same row, again!", "same ROW again", "Same row: again", "x", "same row again", "Same row again", "tail"]
    text = "\n".join(lines) + "\n"
    loop = rules.Loop()
    fired = [loop.observe(text[i:i + 7]) for i in range(0, len(text), 7)]
    batch = BT.repetition_verdicts(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()
    assert [f for f in fired if f] == [batch.norm] == ["same row again"]


def test_tags_may_span_deltas():
    text = "Visible<think> secret </think> more<END> and <hidden_thinking>x</hidden_thinking>end <think>open"
    for size in (1, 3, 7, 200):
        split, out = rules.Split(), []
        pieces = [text[i:i + size] for i in range(0, len(text), size)]
        for i, piece in enumerate(pieces):
            out += split.observe(piece, i == len(pieces) - 1)
        assert "".join(t for k, t in out if k == "visible") == "Visible more and end "
        assert [t for k, t in out if k == "hidden"] == ["secret", "x", "open"]


def test_breaker_pauses_and_recovers():
    b = rules.Breaker()
    assert [b.observe(t, ok, m) for t, ok, m in [
        (0, False, "timeout"), (1, False, "timeout"), (2, True, ""), (300002, True, ""), (300003, False, "model not found"), (300004, True, "")]
    ] == [True, True, False, True, True, False]


def test_state_survives_micro_batches(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    jobs.use_rocksdb(spark)
    for seq in range(6):
        spark.createDataFrame([("s", seq, "the same line\n"), ("t", seq, f"line number {seq} {'x' * seq}\n")],
                              "session_id string, seq long, delta string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("session_id string, seq long, delta string").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_available(jobs.repetition_guard(stream), out, check)
    got = spark.read.parquet(out).collect()
    assert [(r.session_id, r.norm) for r in got] == [("s", "the same line")]


def test_answer_budget_markers(spark):
    long = "a" * 500 + "b" * 500
    got = spark.range(1).select(T.trim_for_budget(F.lit(long), 300).alias("t")).first().t
    assert len(got) == 300 and K.BUDGET_TRIM_MARKER in got and got.startswith("a") and got.endswith("b")
