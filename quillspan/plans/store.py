"""A stored index that is refreshed in place: versions of files and chunks, hashed into buckets by path.

Every change set is one version: the source rows and chunks of the files that changed, or a tombstone for a file that is
gone, written below ``version=<n>/bucket=<b>``.  The newest version of a path is the live one, and its chunks are those
of that version.  A change set that is written again replaces itself, so a micro-batch or job that is replayed changes
nothing; what did not change is not written.  ``compact`` writes the live rows as one version of a new store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspan.operators.refresh import refresh_status
from quillspan.plans.index import index_corpus
from quillspan.session import cut_lineage

SOURCE = (
    "path string, file_name string, source_type string, source_role string, size_bytes bigint, modified_ms bigint, extractor string, "
    "content_hash string, char_count bigint, line_count bigint, word_count bigint, chunk_count bigint, candidates bigint, "
    "filtered bigint, duplicates bigint, chunking_profile string, zero_chunk_reason string, deleted boolean"
)
CHUNK = (
    "path string, file_name string, source_type string, source_role string, chunk_index bigint, text string, fingerprint string, "
    "embedding array<float>, modified_ms bigint"
)
FILE = ["path", "file_name", "size_bytes", "modified_ms", "extractor", "text", "content_hash"]


def _as(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema``; missing ones are null."""
    pairs = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs))


def newest(files: DataFrame) -> DataFrame:
    """Of rows of one path the one with the latest time stays, of equal times the one with the largest content hash."""
    rest = [c for c in files.columns if c != "path"]
    order = F.struct("modified_ms", F.coalesce("content_hash", F.lit("")))
    return files.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("r")).select("path", "r.*")


@dataclass(frozen=True)
class ChunkStore:
    """A store below ``path``, a folder that driver and executors share."""

    spark: SparkSession
    path: str
    buckets: int = 32

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 32) -> ChunkStore:
        """A store that holds nothing yet; one that exists is left as it is."""
        store = cls(spark, path, buckets)
        for name, schema in (("sources", SOURCE), ("chunks", CHUNK)):
            empty = spark.createDataFrame([], f"{schema}, version int, bucket int")
            empty.write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/{name}")
        return store

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, version int, bucket int").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("version") < before)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def next_version(self) -> int:
        last = self._read("sources", SOURCE, None).agg(F.max("version")).first()[0]
        return 0 if last is None else last + 1

    def versions(self, before: int | None = None) -> DataFrame:
        """Newest source row of every path, tombstones included, with its version and bucket."""
        rows = self._read("sources", SOURCE, before)
        rest = [c for c in rows.columns if c not in ("path", "bucket")]
        last = rows.groupBy("bucket", "path").agg(F.max_by(F.struct(*rest), "version").alias("r"))
        return last.select("path", "r.*", "bucket")

    def sources(self, before: int | None = None) -> DataFrame:
        return self.versions(before).where("not deleted")

    def chunks(self, before: int | None = None) -> DataFrame:
        """Live chunks: those that the newest version of their file wrote."""
        live = self.sources(before).select("path", "version", "bucket")
        return self._read("chunks", CHUNK, before).join(live, ["path", "version", "bucket"])

    def write(self, version: int, sources: DataFrame, chunks: DataFrame) -> None:
        """Chunks first, then the sources that make them live; a version that exists is replaced."""
        for name, rows, schema in (("chunks", chunks, CHUNK), ("sources", sources, SOURCE)):
            placed = _as(rows, schema).withColumn("bucket", self._bucket())
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")

    def apply(self, version: int, current: DataFrame, status: DataFrame, removed: DataFrame, vectors: bool = False) -> None:
        """Write the change set ``status`` (path, status) of the files ``current`` (``FILE``) as ``version``.

        New and changed files are indexed, with the vectors of live chunks where fingerprints agree; touched files get their
        rows again with the new time and size; the paths ``removed`` (path, modified_ms) get a tombstone; unchanged files
        are not written.
        """
        todo = status.where(F.col("status").isin("new", "changed")).select("path")
        built = index_corpus(current.join(todo, "path", "left_semi"), self.chunks(version), vectors)
        touched = status.where("status = 'touched'").select("path")
        stamps = current.join(touched, "path", "left_semi").select(
            "path", F.col("modified_ms").alias("now_ms"), F.col("size_bytes").alias("now_bytes"))
        again = lambda rows: rows.join(stamps, "path").withColumn("modified_ms", F.col("now_ms"))
        sources = (
            _as(built.sources.withColumn("deleted", F.lit(False)), SOURCE)
            .unionByName(_as(again(self.sources(version)).withColumn("size_bytes", F.col("now_bytes")), SOURCE))
            .unionByName(_as(removed.withColumn("deleted", F.lit(True)), SOURCE))
        )
        chunks = _as(built.chunks, CHUNK).unionByName(_as(again(self.chunks(version)), CHUNK))
        # both results read the store that they are written to
        self.write(version, cut_lineage(sources, "store-sources"), cut_lineage(chunks, "store-chunks"))

    def refresh(self, files: DataFrame, vectors: bool = False) -> DataFrame:
        """Bring the store to the state ``files`` (path, file_name, size_bytes, modified_ms, extractor, text); (path, status).

        A path of the store that is not among ``files`` is removed; of rows of one path the newest counts.
        """
        version, current = self.next_version(), cut_lineage(newest(_hashed(files)), "store-files")
        status = cut_lineage(refresh_status(current, self.sources(version)), "store-status")
        gone = self.sources(version).select("path", "modified_ms").join(status.where("status = 'removed'").select("path"), "path", "left_semi")
        self.apply(version, current, status, gone, vectors)
        return status

    def upsert(self, version: int, files: DataFrame, vectors: bool = False) -> None:
        """Bring the paths of ``files`` up to date as ``version``; other paths stay.

        A row with a null text removes its path.  A row that is older than the live one, or than the tombstone, is left out.
        """
        known = self.versions(version).select("path", F.col("modified_ms").alias("known_ms"))
        current = cut_lineage(newest(_hashed(files)).join(known, "path", "left").where(
            F.col("known_ms").isNull() | (F.col("modified_ms") >= F.col("known_ms"))).drop("known_ms"), "store-files")
        kept = current.where("text IS NOT NULL")
        live = self.sources(version).join(kept.select("path"), "path", "left_semi")
        status = cut_lineage(refresh_status(kept, live), "store-status")
        self.apply(version, kept, status, current.where("text IS NULL").select("path", "modified_ms"), vectors)

    def compact(self, path: str) -> ChunkStore:
        """A new store at ``path`` with the live rows and nothing else."""
        smaller = ChunkStore.create(self.spark, path, self.buckets)
        smaller.write(0, self.sources(), self.chunks())
        return smaller


def _hashed(files: DataFrame) -> DataFrame:
    if "content_hash" not in files.columns:
        files = files.withColumn("content_hash", F.sha1(F.encode("text", "UTF-8")))
    return files.select(*FILE)


def replacing_ingest(files: DataFrame, store: ChunkStore, checkpoint: str, vectors: bool = False) -> None:
    """Keep ``store`` up to date with a file stream (path, file_name, size_bytes, modified_ms, extractor, text).

    A path that comes again replaces its chunks, a null text removes it, and an older version that comes late changes
    nothing.  A micro-batch is the store version of its number.
    """
    def commit(batch: DataFrame, number: int) -> None:
        store.upsert(number, batch, vectors)

    query = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
