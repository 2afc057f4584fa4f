"""Copy and move plans: validation, expansion, conflicts and method per file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths
from ..operators.drives import storage_classes
from ..operators.lookup import existing_keys
from ..operators.scale import fits_broadcast, running_position
from ..session import materialize
from .requests import expand, hint, reason, with_access

RESOLUTIONS = ("cancel", "overwrite", "skip")


def _with_drive_types(specs: DataFrame, drives: DataFrame, small: bool) -> DataFrame:
    """Specs with the type of both drives; null where a drive does not exist."""
    for side in ("source", "dest"):
        kinds = drives.select(
            F.col("drive_id").alias(f"{side}_drive_id"), F.col("drive_type").alias(f"{side}_type")
        )
        specs = specs.join(hint(kinds, small), f"{side}_drive_id", "left")
    return specs


def transfer_validate(
    specs: DataFrame, drives: DataFrame, rules: DataFrame, user: str, roles: Iterable[str] = ()
) -> DataFrame:
    """Specs with the first reason that rules them out before any item is looked at.

    A move needs Delete on the source, a copy Read; both need Create on the
    destination.
    """
    typed = _with_drive_types(specs, drives, fits_broadcast(drives))
    held = with_access(
        typed, rules, user, roles, "source_drive_id", "source_path", ["D", "R"], "source"
    )
    held = with_access(held, rules, user, roles, "dest_drive_id", "dest_path", ["C"], "dest")
    source, dest, move = F.col("source_path"), F.col("dest_path"), F.col("remove_source")
    same_drive = F.col("source_drive_id") == F.col("dest_drive_id")
    same = paths.same_source_dest(
        F.col("source_drive_id"), source, F.col("dest_drive_id"), dest
    )
    from_key, to_key = paths.remove_both_slashes(source), paths.remove_both_slashes(dest)
    inside = (from_key == "") | to_key.startswith(F.concat(from_key, F.lit("/")))
    beneath = move & same_drive & inside
    source_held = F.when(move, F.col("source_D")).otherwise(F.col("source_R"))
    why = reason(
        (F.col("source_type").isNull(), "no source drive"),
        (F.col("dest_type").isNull(), "no destination drive"),
        (dest.isNull(), "no destination path"),
        (source.isNull(), "no source path"),
        (same, "same source and destination"),
        (beneath, "moved beneath itself"),
        (~(source_held & F.col("dest_C")), "no permission"),
    )
    return held.select(*specs.columns, "source_type", "dest_type", why.alias("reason"))


def _covered(specs: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Valid specs with the files and folders they move, re-based to the destination."""
    below = expand(specs, items, "source_drive_id", "source_path", small).where(~F.col("is_self"))
    classes = storage_classes(items.sparkSession).select(
        F.col("drive_type").alias("source_type"),
        F.col("storage_class").alias("item_storage_class"),
        "restore_required",
    )
    moved = paths.move_below(F.col("item_path"), F.col("source_path"), F.col("dest_path"))
    return below.join(F.broadcast(classes), ["source_type", "item_storage_class"], "left").select(
        *specs.columns,
        "item_path",
        "item_file_size",
        (F.col("item_directory") | paths.is_directory(F.col("item_path"))).alias("is_folder"),
        "in_folder",
        F.coalesce("restore_required", F.lit(False)).alias("archived"),
        F.when(F.col("in_folder"), moved).otherwise(F.col("dest_path")).alias("item_dest"),
    )


def covered_items(specs: DataFrame, items: DataFrame) -> DataFrame:
    """Specs that passed validation with the items they move."""
    return _covered(specs, items, fits_broadcast(specs))


def transfer_plan(
    specs: DataFrame,
    items: DataFrame,
    drives: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
    resolution: str = "cancel",
) -> DataFrame:
    """One row per item of each accepted spec, one row per rejected spec.

    Decision is transfer, skip or reject. An archived file, or under ``cancel``
    an existing destination, rejects the whole spec; where several files have the
    same destination it exists for all but the first in order of spec and path. Method is mkdir for a
    folder, empty for an empty file, rename or copy within a drive and chunk
    between drives; files of a moved folder are copied, and the folder is
    removed once they are.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution: {resolution}")
    checked = materialize(transfer_validate(specs, drives, rules, user, roles), "transfer-specs")
    return decide_transfers(checked, items, resolution)


def decide_transfers(checked: DataFrame, items: DataFrame, resolution: str) -> DataFrame:
    """The plan of validated specs (columns of `transfer_validate`), which are read several times."""
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    small = fits_broadcast(valid)
    covered = materialize(_covered(valid, items, small), "transfer-items")

    # the spec's own destination is looked up along with those of its items
    whole = valid.select(
        "spec_id", "dest_drive_id", F.col("dest_path").alias("item_dest"), F.lit(True).alias("is_spec")
    )
    asked = covered.withColumn("is_spec", F.lit(False)).unionByName(whole, allowMissingColumns=True)
    asked = asked.withColumn("dest_key", paths.remove_both_slashes(F.col("item_dest")))
    key = ["dest_drive_id", "dest_key"]
    known = existing_keys(items, asked.select(*key).toDF("drive_id", "key")).toDF(*key)
    # of files with one destination the first finds it free, the others find that one there
    own = F.struct("spec_id", "item_path")
    shared = (
        asked.where(~F.col("is_spec") & ~F.col("is_folder")).groupBy(*key)
        .agg(F.min(own).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    later = ~F.col("is_spec") & ~F.col("is_folder") & (F.col("_first") != own)
    found = materialize(
        asked.join(known.withColumn("exists", F.lit(True)), key, "left").join(shared, key, "left")
        .withColumn("exists", F.coalesce("exists", F.lit(False)) | F.coalesce(later, F.lit(False)))
        .drop("_first"),
        "transfer-found",
    )

    is_item, is_spec = ~F.col("is_spec"), F.col("is_spec")
    clash = F.bool_or(is_item & F.col("exists") & ~F.col("is_folder")) | (
        F.bool_or(is_item & F.col("in_folder")) & F.bool_or(is_spec & F.col("exists"))
    )
    verdict = found.groupBy("spec_id").agg(
        reason(
            (F.count(F.when(is_item, 1)) == 0, "source not found"),
            (F.bool_or("archived"), "archived"),
            (F.lit(resolution == "cancel") & clash, "destination exists"),
        ).alias("reason")
    )
    refused_late = verdict.where(F.col("reason").isNotNull())

    same_drive = F.col("source_drive_id") == F.col("dest_drive_id")
    alone = F.col("remove_source") & ~F.col("in_folder")
    conflict = F.col("exists") & ~F.col("is_folder")
    skipped = conflict & F.lit(resolution == "skip")
    method = (
        F.when(F.col("is_folder"), "mkdir")
        .when(F.col("item_file_size") == 0, "empty")
        .when(same_drive, F.when(alone, "rename").otherwise("copy"))
        .otherwise("chunk")
    )
    accepted = found.where(is_item).join(
        hint(refused_late.select("spec_id"), small), "spec_id", "left_anti"
    ).select(
        "spec_id",
        "source_drive_id",
        F.col("item_path").alias("source_path"),
        "dest_drive_id",
        F.col("item_dest").alias("dest_path"),
        F.col("item_file_size").alias("file_size"),
        F.when(skipped, "skip").otherwise("transfer").alias("decision"),
        F.when(~skipped, method).alias("method"),
        (conflict & F.lit(resolution == "overwrite")).alias("replaces"),
        F.lit(None).cast("string").alias("reason"),
    )
    refused = checked.where(F.col("reason").isNotNull()).unionByName(
        checked.drop("reason").join(hint(refused_late, small), "spec_id")
    )
    rejected = refused.select(
        "spec_id",
        "source_drive_id",
        "source_path",
        "dest_drive_id",
        "dest_path",
        F.lit(None).cast("bigint").alias("file_size"),
        F.lit("reject").alias("decision"),
        F.lit(None).cast("string").alias("method"),
        F.lit(False).alias("replaces"),
        "reason",
    )
    return accepted.unionByName(rejected)


def transfer_counts(specs: DataFrame, items: DataFrame) -> DataFrame:
    """Items each spec stands for: one for a file, all descendants for a folder."""
    small = fits_broadcast(specs)
    below = expand(specs, items, "source_drive_id", "source_path", small).where(~F.col("is_self"))
    counts = below.groupBy("spec_id").agg(F.count(F.when(F.col("in_folder"), 1)).alias("_below"))
    named_folder = F.when(paths.is_directory(F.col("source_path")), 0).otherwise(1)
    total = F.when(F.col("_below") > 0, F.col("_below")).otherwise(named_folder)
    return specs.join(hint(counts, small), "spec_id", "left").select(
        "spec_id", total.cast("bigint").alias("items")
    )


def any_archived(specs: DataFrame, items: DataFrame, drives: DataFrame) -> DataFrame:
    """Specs whose source holds at least one archived file."""
    small = fits_broadcast(specs)
    typed = _with_drive_types(specs, drives, fits_broadcast(drives))
    return (
        _covered(typed, items, small)
        .groupBy("spec_id")
        .agg(F.bool_or("archived").alias("any_archived"))
    )


def items_by_path(plan: DataFrame) -> DataFrame:
    """Plan rows with their place in path order within each spec."""
    return running_position(plan, ["spec_id"], ["source_path"], "ordinal")


def rename_plan(
    specs: DataFrame,
    items: DataFrame,
    drives: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
) -> DataFrame:
    """New key for every key below the old one; one row per refused spec.

    Needs Read on the source and Create on the destination, the same drive, and
    a destination that does not exist yet and that no earlier spec takes. An item is renamed
    once, by the first spec that covers it; a spec that is left without any finds no source.
    """
    typed = _with_drive_types(specs, drives, fits_broadcast(drives))
    held = with_access(typed, rules, user, roles, "source_drive_id", "source_path", ["R"], "source")
    held = with_access(held, rules, user, roles, "dest_drive_id", "dest_path", ["C"], "dest")
    held = materialize(held, "rename-specs")
    key = ["dest_drive_id", "dest_key"]
    keyed = held.withColumn("dest_key", paths.remove_both_slashes(F.col("dest_path")))
    existing = existing_keys(items, keyed.select(*key).toDF("drive_id", "key")).toDF(*key)
    found = keyed.join(existing.withColumn("exists", F.lit(True)), key, "left")
    why = reason(
        (F.col("source_type").isNull(), "no source drive"),
        (F.col("source_path").isNull(), "no source path"),
        (F.col("dest_path").isNull(), "no destination path"),
        (F.col("dest_type").isNull(), "no destination drive"),
        (~(F.col("source_R") & F.col("dest_C")), "no permission"),
        (F.col("source_drive_id") != F.col("dest_drive_id"), "across drives"),
        (F.col("exists"), "destination exists"),
    )
    checked = materialize(found.select(*specs.columns, why.alias("reason")), "rename-checked")
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    # of specs with one destination the first takes it
    to_key = paths.remove_both_slashes(F.col("dest_path"))
    takers = valid.groupBy("dest_drive_id", to_key.alias("_key")).agg(F.min("spec_id").alias("_taker"))
    placed = valid.withColumn("_key", to_key).join(takers, ["dest_drive_id", "_key"])
    late = placed.where(F.col("spec_id") != F.col("_taker")).select(
        *specs.columns, F.lit("destination exists").alias("reason")
    )
    valid = placed.where(F.col("spec_id") == F.col("_taker")).select(*specs.columns)
    small = fits_broadcast(valid)
    moved = paths.move_below(F.col("item_path"), F.col("source_path"), F.col("dest_path"))
    # an item that several specs cover is gone for all but the first
    first = F.min("spec_id").over(Window.partitionBy("source_drive_id", "item_path"))
    covered = materialize(
        expand(valid, items, "source_drive_id", "source_path", small)
        .withColumn("_first", first).where(F.col("spec_id") == F.col("_first")).drop("_first"),
        "rename-items",
    )
    renamed = covered.select(
        "spec_id",
        F.col("source_drive_id").alias("drive_id"),
        F.col("item_path").alias("old_path"),
        F.when(F.col("in_folder") | F.col("is_self"), moved)
        .otherwise(F.col("dest_path")).alias("new_path"),
        F.lit("rename").alias("decision"),
        F.lit(None).cast("string").alias("reason"),
    )
    missing = valid.join(
        hint(covered.select("spec_id").distinct(), small), "spec_id", "left_anti"
    ).withColumn("reason", F.lit("source not found"))
    refused = checked.where(F.col("reason").isNotNull()).unionByName(missing).unionByName(late)
    rejected = refused.select(
        "spec_id",
        F.col("source_drive_id").alias("drive_id"),
        F.col("source_path").alias("old_path"),
        F.col("dest_path").alias("new_path"),
        F.lit("reject").alias("decision"),
        "reason",
    )
    return renamed.unionByName(rejected)
