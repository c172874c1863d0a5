"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillspan", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; cluster values win when already set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which the session names; a single machine without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return os.path.join(shared_dir(spark), "quillspan", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor then re-reads files instead of re-running the plan above.  Files are read a few times and kept for
    long, so they are compressed well.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def cut_and_clean(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage``; Spark drops the shuffle files of this write at its end, not when the driver next collects garbage."""
    setting, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        return cut_lineage(df, name)
    finally:
        conf.set(setting, before)
