"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content.  A ledger table remembers which blobs were scanned under which
rule version; only unseen (blob, rule version) pairs are scanned, each once however many paths hold it, and findings
are joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspan.llm.common import small
from quillspan.session import cut_lineage

# The base rules, by kind in order; (pattern, group whose length counts, least length).
BASE = {
    "assign": (re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
    ), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # Shorter runs would fail the length test; as runs end only where no hex digit follows, none of them hides a longer one.
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Rules that the scan adds to the base ones.
ADDED = {
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    "bearer": (re.compile(r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"), 0, 27),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), 0, 21),
    "userinfo": (re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:([^\s/@]{3,80})@"), 1, 3),
}
KINDS = {**BASE, **ADDED}
#: Goes into the ledger; a new one makes every blob unseen.
RULES_VERSION = "1"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of the kinds; per kind left-most, not overlapping."""
    found = [
        (m.start(), k, m.end(), kind) for k, (kind, (pattern, group, least)) in enumerate(KINDS.items())
        for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def with_blob(versions: DataFrame, text_col: str = "text", out_col: str = "blob") -> DataFrame:
    """Append the content address: SHA-256 of the text in UTF-8, null as empty."""
    return versions.withColumn(out_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rules string, spans {_SPANS}")


def scan_blobs(blobs: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """New ledger rows of ``blobs`` (blob, text): blob, rules, spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in small(batches):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t or "")] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([rules] * len(spans)), pa.array(spans, kind)], ["blob", "rules", "spans"]
            )

    return blobs.select("blob", "text").mapInArrow(run, f"blob string, rules string, spans {_SPANS}")


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION, path_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen; (findings: path, blob, spans of every version, new ledger rows to append).

    Null texts are the empty blob.  Null paths and repeated (path, text) rows keep rows of their own.  An empty table
    gives empty results; columns besides the two are not read.
    """
    spark = versions.sparkSession
    read = with_blob(versions.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text")))
    ledger = empty_ledger(spark) if ledger is None else ledger
    known = ledger.where(F.col("rules") == rules)
    # one text for each blob: a task sends each of its blobs once, so copies and hot blobs are combined before the exchange
    unseen = read.groupBy("blob").agg(F.first("text").alias("text")).join(known.select("blob"), "blob", "left_anti")
    new = cut_lineage(scan_blobs(unseen, rules), "secret-ledger")
    hits = known.unionByName(new).where(F.size("spans") > 0).select("blob", "spans")
    findings = read.select("path", "blob").join(hits, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )
    return findings, new


def spans_text(kinds: list[str] | None = None):
    """``spans`` as kind:start:end, comma-joined; only some kinds if given."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(kinds)) if kinds else F.col("spans")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(chosen, text), ",")


def count_kind(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
