"""Page tables do one document's work once, not once a page."""

from __future__ import annotations

from quillspan.operators import pages as PG


def test_a_page_carries_only_itself(spark):
    docs = spark.createDataFrame([(1, "a\fb")], "doc_id bigint, text string")
    plan = PG.raw_pages(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[:plan.index("Generate")]


def test_boilerplate_of_plain_null_and_repeated_ids(spark):
    pages = "\f".join(f"Head\n\nHead\nbody {k}\nFoot\nfoot" for k in range(4))
    rows = [(1, pages), (2, "Head\nx\fHead\ny"), (None, "p\fq"), (None, pages), (3, "Head\nFoot\f \fHead\nFoot\fHead\nz\nFoot"), (4, None)]
    docs = spark.createDataFrame([*rows, (5, pages), (5, pages)], "doc_id bigint, text string")
    got = {(r.doc_id, r.page_no, r.text) for r in PG.strip_boilerplate(docs).collect()}
    body = lambda k: f"Head\nbody {k}"
    assert {x for x in got if x[0] == 1} == {(1, k + 1, body(k)) for k in range(4)}
    assert {x for x in got if x[0] == 2} == {(2, 1, "Head\nx"), (2, 2, "Head\ny")}
    assert {x for x in got if x[0] is None} == {(None, 1, "p"), (None, 2, "q")}
    assert {x for x in got if x[0] == 3} == {(3, 1, "z")}
    assert {x[2] for x in got if x[0] == 5} == {"Head\nHead"}  # its pages hold each line twice, so bodies repeat as well
