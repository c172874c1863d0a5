"""Chunks are made some texts at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import segments as SG


def test_chunks_of_few_texts_are_held_at_once(spark):
    files = spark.range(200).select(
        F.col("id").alias("path"), F.lit("doc").alias("source_type"), F.lit(0).alias("size_bytes"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("1. Part\nline of text "), F.col("id").cast("string"))).alias("text"))
    made = SG.chunk_texts(files.coalesce(1), keep_text=False)
    assert made.columns == ["path", "source_type", "size_bytes", "blocks_n", "profile_label", "chunks"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    rows = {r["path"]: r for r in made.collect()}
    assert len(rows) == 200 and not rows[0].chunks
    assert "line of text 199" in rows[199].chunks[-1].text
