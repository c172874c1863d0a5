"""The actionability score."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import lines as L


def test_actionability_cleans_the_text_once(spark):
    frame = spark.createDataFrame([("  1. Install the pod  \n- run = x\n",), (None,), ("",)], "text string")
    plan = frame.where(L.actionability(F.col("text")) > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("btrim") + plan.count("trim(") <= 2
