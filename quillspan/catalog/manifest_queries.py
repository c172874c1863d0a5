"""Manifest edits over files derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog import derived as D
from quillspan.catalog.registry import query
from quillspan.operators import manifest as MF

MAN = D.sql(D.manifest)


def imports(d) -> str:
    """Files to import: many of one collection want the same name."""
    return (
        f"SELECT doc_id AS ord, lang AS collection_id, 'Label ' || lang AS collection_label, '2024' AS created_at, "
        f"source || '/note.' || CASE WHEN doc_id % 3 = 0 THEN 'txt' ELSE 'md' END AS relative_path, '/orig/' || {d.text('doc_id')} AS original_path FROM {d.table('documents')}"
    )


_IMPORT = f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY collection_id, relative_path ORDER BY ord) - 1 AS n FROM ({imports(D.Duck())})),
    u AS (SELECT *, CASE WHEN n = 0 THEN relative_path ELSE regexp_replace(relative_path, '\\.([a-z]+)$', '_' || n || '.\\1') END AS up FROM r)
    --final
"""
query("unique_paths", "ord:b, collection_id:s, unique_path:s", _IMPORT + "SELECT ord, collection_id, up AS unique_path FROM u")(
    lambda spark, sf: MF.unique_paths(D.frame(spark, sf, imports)))

query("import_entries", "collection_id:s, internal_path:s, relative_path:s, original_path:s, group_id:s, group_label:s", _IMPORT + """
    SELECT collection_id, 'kb/' || collection_id || '/' || up AS internal_path, up AS relative_path, original_path, sha1(collection_id || '|' || split_part(up, '/', 1)) AS group_id,
    split_part(up, '/', 1) AS group_label FROM u""")(
    lambda spark, sf: MF.import_entries(D.frame(spark, sf, imports), "kb"))


def _manifest(spark, sf_dir):
    return D.frame(spark, sf_dir, D.manifest)


query("remove_entries", "internal_path:s, collection_id:s", f"SELECT internal_path, collection_id FROM ({MAN}) WHERE ord % 3 <> 1")(
    lambda spark, sf: MF.remove_entries(_manifest(spark, sf), _manifest(spark, sf).filter("ord % 3 = 1")))

query("drop_collections", "internal_path:s, collection_id:s", f"SELECT internal_path, collection_id FROM ({MAN}) WHERE collection_id <> 'fr'")(
    lambda spark, sf: MF.drop_collections(_manifest(spark, sf), _manifest(spark, sf).filter("collection_id = 'fr'")))

query("move_entries", "collection_id:s, internal_path:s, relative_path:s, group_label:s, group_id:s", f"""
    SELECT CASE WHEN mv THEN 'moved' ELSE collection_id END AS collection_id, CASE WHEN mv THEN 'kb/moved/' || np ELSE internal_path END AS internal_path,
    CASE WHEN mv THEN np ELSE relative_path END AS relative_path, CASE WHEN mv THEN split_part(np, '/', 1) ELSE group_label END AS group_label,
    CASE WHEN mv THEN sha1('moved|' || split_part(np, '/', 1)) ELSE group_id END AS group_id
    FROM (SELECT *, ord % 4 = 2 AS mv, CASE WHEN ord % 8 = 2 THEN 'all/' || split_part(relative_path, '/', -1) ELSE relative_path END AS np FROM ({MAN}))""")(
    lambda spark, sf: MF.move_entries(_manifest(spark, sf).drop("ord"), _manifest(spark, sf).filter("ord % 4 = 2").select(
        "internal_path", F.lit("moved").alias("target_id"), F.lit("Moved").alias("target_label"),
        F.when(F.col("ord") % 8 == 2, " all ").otherwise("").alias("target_group"), "ord"), "kb"))

query("rename_entries", "collection_id:s, internal_path:s, relative_path:s, group_label:s", f"""
    WITH m AS (SELECT *, ord % 5 = 1 AS rn, split_part(relative_path, '/', 1) AS folder FROM ({MAN})),
    r AS (SELECT *, row_number() OVER (PARTITION BY collection_id, folder ORDER BY ord) - 1 AS n FROM m WHERE rn),
    u AS (SELECT *, folder || '/new' || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.txt' AS np FROM r)
    --final
    SELECT collection_id, internal_path, relative_path, group_label FROM m WHERE NOT rn
    UNION ALL SELECT collection_id, 'kb/' || collection_id || '/' || np, np, folder FROM u""")(
    lambda spark, sf: MF.rename_entries(_manifest(spark, sf).drop("ord"), _manifest(spark, sf).filter("ord % 5 = 1").select(
        "internal_path", F.lit(" new.txt ").alias("new_name"), "ord"), "kb"))

query("free_labels", "collection_id:s, label:s", f"""
    WITH c AS (SELECT DISTINCT collection_id, collection_label FROM ({MAN})),
    w AS (SELECT collection_id, upper(collection_label) AS label FROM c UNION ALL SELECT collection_id || '2', ' ' || lower(collection_label) FROM c UNION ALL SELECT 'x', collection_id FROM c)
    --final
    SELECT collection_id, label FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE lower(c.collection_label) = lower(trim(w.label)) AND c.collection_id <> w.collection_id)""")(
    lambda spark, sf: _free(spark, sf))


def _free(spark, sf_dir):
    c = _manifest(spark, sf_dir).select("collection_id", F.col("collection_label").alias("label")).distinct()
    wanted = c.select("collection_id", F.upper("label").alias("label")).unionByName(
        c.select(F.concat("collection_id", F.lit("2")).alias("collection_id"), F.concat(F.lit(" "), F.lower("label")).alias("label"))).unionByName(
        c.select(F.lit("x").alias("collection_id"), F.col("collection_id").alias("label")))
    return MF.free_labels(wanted, c)


query("relabel_collections", "internal_path:s, collection_label:s", f"""
    SELECT internal_path, CASE WHEN collection_id = 'fr' THEN 'New fr' ELSE collection_label END AS collection_label FROM ({MAN})""")(
    lambda spark, sf: MF.relabel_collections(_manifest(spark, sf), _manifest(spark, sf).select("collection_id").distinct().select(
        "collection_id", F.when(F.col("collection_id") == "fr", "New fr").otherwise("Label fr").alias("label"))))


def _assets(spark, sf_dir, second: bool):
    rows = D.frame(spark, sf_dir, D.files).select(F.col("source").alias("request_id"), F.col("doc_id").alias("ord"),
                                                  F.concat(F.lit(" "), F.col("lang"), F.lit("/"), (F.col("doc_id") % (7 if second else 3)).cast("string")).alias("path"))
    return rows


query("merged_asset_list", "request_id:s, asset_no:b, path:s", """
    WITH a AS (SELECT source AS request_id, lang || '/' || (doc_id % 3) AS path, 0 AS part, doc_id AS ord FROM documents
        UNION ALL SELECT source, lang || '/' || (doc_id % 7), 1, doc_id FROM documents),
    f AS (SELECT request_id, path, min(struct_pack(p := part, o := ord)) AS m FROM a GROUP BY request_id, path)
    --final
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY m, path) AS asset_no, path FROM f""")(
    lambda spark, sf: MF.merged_asset_list(_assets(spark, sf, False), _assets(spark, sf, True)))
