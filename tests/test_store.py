from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.plans.store import CHUNK, SOURCE, ChunkStore, replacing_ingest

FILES = "path string, file_name string, size_bytes long, modified_ms long, extractor string, text string"
BODY = " ".join(f"word{i}" for i in range(60))


def files(spark, rows):
    return spark.createDataFrame([(p, p.split("/")[-1], len(t or ""), ms, "direct", t) for p, ms, t in rows], FILES)


def state(store):
    return {r.path: (r.modified_ms, r.text) for r in store.chunks().collect()}


def test_refresh_writes_only_what_changed(spark, tmp_path):
    store = ChunkStore.create(spark, str(tmp_path / "s"), 4)
    first = [("kb/a.txt", 1, BODY), ("kb/b.txt", 1, BODY + " b"), ("kb/c.txt", 1, BODY + " c"), ("kb/d.txt", 1, "tiny")]
    assert {r.status for r in store.refresh(files(spark, first)).collect()} == {"new"}
    second = [("kb/a.txt", 1, BODY), ("kb/b.txt", 5, BODY + " b"), ("kb/c.txt", 5, BODY + " changed"), ("kb/e.txt", 5, BODY + " e"), ("kb/e.txt", 4, "older")]
    status = {r.path: r.status for r in store.refresh(files(spark, second)).collect()}
    assert status == {"kb/a.txt": "unchanged", "kb/b.txt": "touched", "kb/c.txt": "changed", "kb/d.txt": "removed", "kb/e.txt": "new"}
    assert state(store) == {"kb/a.txt": (1, BODY), "kb/b.txt": (5, BODY + " b"), "kb/c.txt": (5, BODY + " changed"), "kb/e.txt": (5, BODY + " e")}
    assert {r.path: (r.version, r.modified_ms, r.chunk_count) for r in store.sources().collect()} == {
        "kb/a.txt": (0, 1, 1), "kb/b.txt": (1, 5, 1), "kb/c.txt": (1, 5, 1), "kb/e.txt": (1, 5, 1)}
    written = spark.read.schema(f"{SOURCE}, bucket int").parquet(str(tmp_path / "s/sources/version=1"))
    assert {r.path for r in written.collect()} == {"kb/b.txt", "kb/c.txt", "kb/d.txt", "kb/e.txt"}
    small = store.compact(str(tmp_path / "t"))
    assert state(small) == state(store) and small.versions().where("deleted").count() == 0


def test_a_replayed_change_set_changes_nothing(spark, tmp_path):
    store = ChunkStore.create(spark, str(tmp_path / "s"), 4)
    store.upsert(0, files(spark, [("kb/a.txt", 1, BODY)]))
    for _ in range(2):
        store.upsert(1, files(spark, [("kb/a.txt", 2, BODY + " two"), ("kb/b.txt", 2, BODY)]))
    assert store.chunks().count() == 2 and state(store) == {"kb/a.txt": (2, BODY + " two"), "kb/b.txt": (2, BODY)}


def test_late_and_removed_files(spark, tmp_path):
    store = ChunkStore.create(spark, str(tmp_path / "s"), 4)
    store.upsert(0, files(spark, [("kb/a.txt", 5, BODY), ("kb/b.txt", 5, BODY + " b"), ("kb/gone.txt", 7, None)]))
    store.upsert(1, files(spark, [("kb/a.txt", 3, "an older text " + BODY), ("kb/b.txt", 6, None), ("kb/gone.txt", 6, BODY)]))
    assert state(store) == {"kb/a.txt": (5, BODY)}
    store.upsert(2, files(spark, [("kb/b.txt", 5, BODY), ("kb/gone.txt", 8, BODY + " back")]))
    assert state(store) == {"kb/a.txt": (5, BODY), "kb/gone.txt": (8, BODY + " back")}


def test_vectors_are_shared_across_change_sets(spark, tmp_path):
    store = ChunkStore.create(spark, str(tmp_path / "s"), 4)
    store.upsert(0, files(spark, [("kb/a.txt", 1, BODY)]))
    marked = store.chunks().drop("version", "bucket").withColumn("embedding", F.array(F.lit(4.0).cast("float")))
    store.write(0, _kept(spark, store.sources(), SOURCE), _kept(spark, marked, CHUNK))
    store.upsert(1, files(spark, [("kb/copy.txt", 2, BODY), ("kb/new.txt", 2, BODY + " new")]))
    assert {r.path: r.embedding for r in store.chunks().collect()} == {"kb/a.txt": [4.0], "kb/copy.txt": [4.0], "kb/new.txt": None}


def _kept(spark, rows, schema):
    """The rows without the files that they come from."""
    return spark.createDataFrame([tuple(r) for r in rows.select(*[c.split(" ")[0] for c in schema.split(", ")]).collect()], schema)


def test_stream_of_several_batches(spark, tmp_path):
    source, store = str(tmp_path / "in"), ChunkStore.create(spark, str(tmp_path / "s"), 4)
    for rows in ([("kb/a.txt", 2, BODY + " two")], [("kb/a.txt", 1, BODY), ("kb/b.txt", 1, BODY + " b")], [("kb/a.txt", 3, BODY + " three"), ("kb/b.txt", 3, None)]):
        files(spark, rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(source)
    replacing_ingest(stream, store, str(tmp_path / "check"))
    assert state(store) == {"kb/a.txt": (3, BODY + " three")} and store.next_version() == 3
