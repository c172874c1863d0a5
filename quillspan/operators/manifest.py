"""Manifest rows: import, add, remove, move, rename, relabel, unique paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.functions import labels as LB, text as T
from quillspan.session import cut_lineage

ENTRY = ["collection_id", "collection_label", "created_at", "internal_path", "relative_path", "original_path",
         "group_id", "group_label"]


def _numbered_name(path: Column, n: Column) -> Column:
    """``name_n.ext`` in the same folder; the suffix is the part after the last dot of the name."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*\z", 1)
    name = F.substring_index(path, "/", -1)
    has_suffix = name.rlike(r"^.+\.[^.]*\z")
    base = F.when(has_suffix, F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    ext = F.when(has_suffix & ~name.endswith("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return F.concat(folder, base, F.lit("_"), n.cast("string"), ext)


def unique_paths(rows: DataFrame, scope: str = "collection_id", path: str = "relative_path", order: str = "ord",
                 taken: DataFrame | None = None) -> DataFrame:
    """Adds ``unique_path``: the wanted path, or ``name_1.ext``, ``name_2.ext`` on collision.

    Every row asks for its next name and a name goes to the lowest order that asks
    for it, so the outcome equals handling the rows one by one.  Rows that lose a
    name ask again in the next round; a round without a loser ends the loop.  Each
    round is written to the shared folder, so no round re-runs the earlier ones.
    """
    state = rows.withColumn("_n", F.lit(0))
    busy = None if taken is None else taken.select(scope, F.col(path).alias("unique_path")).distinct().withColumn(
        "_busy", F.lit(True))
    while True:
        wanted = F.when(F.col("_n") == 0, F.col(path)).otherwise(_numbered_name(F.col(path), F.col("_n")))
        asked = state.withColumn("unique_path", wanted)
        if busy is None:
            asked = asked.withColumn("_busy", F.lit(None).cast("boolean"))
        else:
            asked = asked.join(busy, [scope, "unique_path"], "left")
        rivals = Window.partitionBy(scope, "unique_path").orderBy(order)
        same_name = Window.partitionBy(scope, path, "_n").orderBy(order)
        lost = F.col("_busy").isNotNull() | (F.row_number().over(rivals) > 1)
        asked = asked.withColumn("_lost", lost).withColumn(
            "_step", F.greatest(F.lit(1), F.row_number().over(same_name) - 1))
        asked = cut_lineage(asked, "unique-paths")
        if asked.filter("_lost").isEmpty():
            return asked.select(*rows.columns, "unique_path")
        state = asked.withColumn("_n", F.when(F.col("_lost"), F.col("_n") + F.col("_step")).otherwise(F.col("_n"))).select(
            *rows.columns, "_n")


def import_entries(files: DataFrame, root: str) -> DataFrame:
    """Manifest rows of imported files: (collection_id, collection_label, created_at, relative_path, original_path, ord)."""
    named = unique_paths(files)
    group = LB.group_label(F.col("unique_path"))
    return named.select(
        "collection_id", "collection_label", "created_at",
        F.concat_ws("/", F.lit(root), "collection_id", "unique_path").alias("internal_path"),
        F.col("unique_path").alias("relative_path"), "original_path",
        LB.group_id(F.col("collection_id"), group).alias("group_id"), group.alias("group_label"))


def collection_id_for(label: Column, created_at: Column, paths: Column) -> Column:
    return F.sha1(F.encode(F.concat_ws("|", T.trimmed(label), created_at, paths), "UTF-8"))


def remove_entries(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select("internal_path").distinct(), "internal_path", "left_anti")


def drop_collections(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    return manifest.join(ids.select("collection_id").distinct(), "collection_id", "left_anti")


def move_entries(manifest: DataFrame, moves: DataFrame, root: str) -> DataFrame:
    """Move entries to (target_id, target_label[, target_group]); names that collide there are numbered.

    moves: internal_path, target_id, target_label, target_group (blank keeps the path), ord.
    """
    plan = manifest.join(moves, "internal_path", "left")
    name = F.substring_index("relative_path", "/", -1)
    wanted = F.when(T.is_blank(F.coalesce("target_group", F.lit(""))), F.col("relative_path")).otherwise(
        F.concat_ws("/", T.trimmed(F.col("target_group")), name))
    same = (F.col("target_id") == F.col("collection_id")) & (wanted == F.col("relative_path"))
    moving = F.col("target_id").isNotNull() & ~F.coalesce(same, F.lit(False))
    kept = plan.filter(~moving).select(*ENTRY)
    going = plan.filter(moving).select(
        F.col("target_id").alias("collection_id"), F.col("target_label").alias("collection_label"), "created_at",
        wanted.alias("relative_path"), "original_path", "ord")
    taken = kept.select("collection_id", "relative_path")
    moved = unique_paths(going, taken=taken)
    group = LB.group_label(F.col("unique_path"))
    moved = moved.select(
        "collection_id", "collection_label", "created_at",
        F.concat_ws("/", F.lit(root), "collection_id", "unique_path").alias("internal_path"),
        F.col("unique_path").alias("relative_path"), "original_path",
        LB.group_id(F.col("collection_id"), group).alias("group_id"), group.alias("group_label"))
    return kept.unionByName(moved)


def rename_entries(manifest: DataFrame, names: DataFrame, root: str) -> DataFrame:
    """New file names by internal_path (internal_path, new_name, ord); the folder stays."""
    plan = manifest.join(names, "internal_path", "left")
    folder = LB.parent_path(F.col("relative_path"))
    wanted = F.when(folder == "", F.trim("new_name")).otherwise(F.concat_ws("/", folder, F.trim("new_name")))
    change = F.col("new_name").isNotNull() & (F.trim("new_name") != "") & (wanted != F.col("relative_path"))
    keep = plan.filter(~F.coalesce(change, F.lit(False))).select(*ENTRY)
    going = plan.filter(change).select(*[c for c in ENTRY if c not in ("internal_path", "relative_path", "group_id",
                                                                       "group_label")],
                                       wanted.alias("relative_path"), "ord")
    moved = unique_paths(going, taken=keep.select("collection_id", "relative_path"))
    group = LB.group_label(F.col("unique_path"))
    moved = moved.select(
        "collection_id", "collection_label", "created_at",
        F.concat_ws("/", F.lit(root), "collection_id", "unique_path").alias("internal_path"),
        F.col("unique_path").alias("relative_path"), "original_path",
        LB.group_id(F.col("collection_id"), group).alias("group_id"), group.alias("group_label"))
    return keep.unionByName(moved)


def free_labels(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """Wanted (collection_id, label) rows whose label no other collection has, whatever the case.

    A label held only by the asking collection itself is free: labels held by one
    collection are compared by id, labels held by several are taken.
    """
    held = collections.select(F.lower("label").alias("k"), F.col("collection_id").alias("held_by")).distinct()
    owners = held.groupBy("k").agg(F.count(F.lit(1)).alias("owners"), F.min("held_by").alias("owner"))
    return (
        wanted.withColumn("k", F.lower(T.trimmed(F.col("label")))).join(owners, "k", "left")
        .filter((F.col("k") != "") & (F.col("owners").isNull()
                                      | ((F.col("owners") == 1) & (F.col("owner") == F.col("collection_id")))))
        .drop("k", "owners", "owner")
    )


def relabel_collections(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Apply the free labels among (collection_id, label)."""
    current = manifest.select("collection_id", F.col("collection_label").alias("label")).distinct()
    ok = free_labels(labels, current).select("collection_id", T.trimmed(F.col("label")).alias("new_label"))
    return (
        manifest.join(ok, "collection_id", "left")
        .withColumn("collection_label", F.coalesce("new_label", "collection_label")).drop("new_label")
    )


def merged_asset_list(pinned: DataFrame, one_shot: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, asset_no, path): pinned first, then one-shot paths; trimmed, unique, order kept."""
    rows = pinned.withColumn("part", F.lit(0)).unionByName(one_shot.withColumn("part", F.lit(1)))
    rows = rows.withColumn("path", T.trimmed(F.col("path"))).filter("path != ''")
    once = rows.groupBy(request, "path").agg(F.min(F.struct("part", "ord")).alias("first"))
    order = Window.partitionBy(request).orderBy("first.part", "first.ord", "path")
    return once.withColumn("asset_no", F.row_number().over(order)).select(request, "asset_no", "path")
