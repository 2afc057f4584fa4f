"""Transfers carried out one request after another, in as few stages as their order allows.

An earlier request changes what a later one finds: what it moved away is gone, what it
created is there, and a destination it freed is free. Requests whose folders do not
meet share a stage; each stage is one plan over the items as the stages before left them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators.drives import storage_classes
from ..operators.scale import broadcast_if_small
from ..session import materialize
from .transfer import RESOLUTIONS, decide_transfers, transfer_validate

STATE = ["drive_id", "path", "file_size", "directory", "storage_class"]


def _touches(valid: DataFrame) -> DataFrame:
    """(spec_id, drive_id, key, write): the trees a spec reads or changes, by folder key."""
    source = F.struct(
        F.col("source_drive_id").alias("drive_id"),
        paths.folder_key(F.col("source_path")).alias("key"),
        F.coalesce("remove_source", F.lit(False)).alias("write"),
    )
    dest = F.struct(
        F.col("dest_drive_id").alias("drive_id"),
        paths.folder_key(F.col("dest_path")).alias("key"),
        F.lit(True).alias("write"),
    )
    return valid.select("spec_id", F.inline(F.array(source, dest)))


def _ready(waiting: DataFrame) -> DataFrame:
    """The specs that no earlier waiting spec has to be carried out before.

    Two trees meet when one lies in the other, and that matters when one of them is written. The
    earliest spec in, at or above each key comes from equality joins over keys and
    their ancestors, so specs are never paired with each other.
    """
    earliest = [
        F.min("spec_id").alias("_any"),
        F.min(F.when(F.col("write"), F.col("spec_id"))).alias("_write"),
    ]
    at = waiting.groupBy("drive_id", "key").agg(*earliest)
    chains = at.select(
        "*", F.explode(paths.self_and_ancestors_of_folder(F.col("key"))).alias("_above")
    )
    inside = chains.groupBy("drive_id", F.col("_above").alias("key")).agg(
        F.min("_any").alias("_any_in"), F.min("_write").alias("_write_in")
    )
    holders = at.toDF("drive_id", "_above", "_any_over", "_write_over")
    over = chains.join(holders, ["drive_id", "_above"]).groupBy("drive_id", "key").agg(
        F.min("_any_over").alias("_any_over"), F.min("_write_over").alias("_write_over")
    )
    writes = F.least("_write_in", "_write_over")
    first = F.when(F.col("write"), F.least("_any_in", "_any_over")).otherwise(writes)
    blocked = F.coalesce(first < F.col("spec_id"), F.lit(False))
    return (
        waiting.join(inside, ["drive_id", "key"]).join(over, ["drive_id", "key"])
        .groupBy("spec_id").agg(F.bool_or(blocked).alias("_blocked"))
        .where(~F.col("_blocked")).select("spec_id")
    )


def _within(items: DataFrame, touches: DataFrame) -> DataFrame:
    """The items that lie in a touched tree or are named by its key."""
    keys = broadcast_if_small(touches.select("drive_id", "key").distinct())
    parent = paths.parent_folder_path(F.col("path"))
    folders = items.select("drive_id", parent.alias("_parent")).distinct()
    reached = (
        folders.select("*", F.explode(paths.self_and_ancestors_of_folder(F.col("_parent"))).alias("key"))
        .join(keys, ["drive_id", "key"], "left_semi").select("drive_id", "_parent").distinct()
    )
    keyed = items.withColumn("_parent", parent).withColumn("_key", paths.folder_key(F.col("path")))
    named = keys.toDF("drive_id", "_key").withColumn("_named", F.lit(True))
    marked = keyed.join(reached.withColumn("_reached", F.lit(True)), ["drive_id", "_parent"], "left")
    return marked.join(named, ["drive_id", "_key"], "left").where(
        F.col("_named") | F.col("_reached")
    ).select(*items.columns)


def _gone(plan: DataFrame, moves: DataFrame, items: DataFrame) -> DataFrame:
    """(spec_id, drive_id, path, method) of what the accepted moves take away.

    The stored row of a folder goes along unless a file below it was skipped; a source that
    the same plan writes anew stays.
    """
    mine = moves.select("spec_id", paths.folder_key(F.col("source_path")).alias("_folder"))
    rows = plan.where("decision <> 'reject'").join(mine, "spec_id").withColumnsRenamed(
        {"source_drive_id": "drive_id", "source_path": "path"}
    )
    stored = items.where(_is_folder()).select(
        "drive_id", "path", paths.folder_key(F.col("path")).alias("_folder")
    )
    own = stored.join(rows.select("spec_id", "drive_id", "_folder").distinct(), ["drive_id", "_folder"])
    moved = rows.where("decision = 'transfer'").select("spec_id", "drive_id", "path", "method")
    taken = moved.unionByName(own.select("spec_id", "drive_id", "path", F.lit("mkdir").alias("method")))
    kept = rows.where("decision = 'skip'").select(
        "drive_id", F.explode(paths.ancestors(F.col("path"), with_root=True)).alias("_folder")
    ).distinct()
    folder = F.when(F.col("method") == "mkdir", paths.folder_key(F.col("path")))
    stays = taken.withColumn("_folder", folder).join(kept, ["drive_id", "_folder"], "left_anti")
    return _without(stays.drop("_folder"), _created(plan))


def _is_folder() -> Column:
    return F.coalesce("directory", F.lit(False)) | paths.is_directory(F.col("path"))


def _bare(path: str) -> Column:
    return paths.remove_first_slash(F.col(path))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (drive, path) is not among the keys, a leading slash aside."""
    others = keys.select("drive_id", _bare("path").alias("_bare")).distinct()
    return rows.withColumn("_bare", _bare("path")).join(
        others, ["drive_id", "_bare"], "left_anti"
    ).drop("_bare")


def _created(plan: DataFrame) -> DataFrame:
    """(drive_id, path, file_size, directory) of what a plan writes; the last row of a path stays."""
    folder = F.col("method") == "mkdir"
    key = paths.remove_both_slashes(F.col("dest_path"))
    return (
        plan.where("decision = 'transfer'")
        .groupBy(
            F.col("dest_drive_id").alias("drive_id"),
            F.when(folder, F.concat(key, F.lit("/"))).otherwise(key).alias("path"),
        )
        .agg(
            F.max_by("file_size", F.struct("spec_id", "source_path")).alias("file_size"),
            F.bool_or(folder).alias("directory"),
        )
    )


def _left_by(
    items: DataFrame, plan: DataFrame, gone: DataFrame, drives: DataFrame, waiting: DataFrame
) -> DataFrame:
    """The items after a stage, as far as a waiting spec may look at them.

    What was written has the default storage class of its drive.
    """
    created = _created(plan)
    defaults = storage_classes(items.sparkSession).where("is_default").select("drive_type", "storage_class")
    classes = drives.select("drive_id", "drive_type").join(F.broadcast(defaults), "drive_type").select(
        "drive_id", F.col("storage_class")
    )
    typed = created.join(broadcast_if_small(classes), "drive_id", "left").select(*STATE)
    changed = gone.select("drive_id", "path").unionByName(created.select("drive_id", "path"))
    return _within(_without(items, changed).unionByName(typed), waiting)


def transfer_sequence(
    specs: DataFrame,
    items: DataFrame,
    drives: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
    resolution: str = "cancel",
) -> DataFrame:
    """The plan of a batch whose requests are carried out in order of spec_id.

    The rows are those of `transfer_plan`, decided on what the earlier requests left, with the `stage` a row
    belongs to and its `step`: transfers come first (1), then rows of decision ``remove`` that take the sources
    of moves away (2; a ``rename`` needs none). Rows of one stage and step may be carried out at once. A refused
    request changes nothing; a move that skips a file leaves it and the folders above it.

    spec_id has to be unique and not null. A null `remove_source` is a copy; refusals that need no look at the
    items are in stage 1. The number of stages is the length of the longest chain of requests
    that touch each other's folders, and only items in folders that waiting requests name
    are carried from stage to stage. Extra columns of the inputs are ignored.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution: {resolution}")
    asked = specs.select(
        "spec_id", "source_drive_id", "source_path", "dest_drive_id", "dest_path",
        F.coalesce("remove_source", F.lit(False)).alias("remove_source"),
    )
    checked = materialize(transfer_validate(asked, drives, rules, user, roles), "sequence-specs")
    valid, refused = checked.where("reason IS NULL"), checked.where("reason IS NOT NULL")
    waiting = materialize(_touches(valid), "sequence-touches")
    state = items.select(*STATE)
    stage, rows = 0, None
    while True:
        stage += 1
        ready = materialize(_ready(waiting), "sequence-ready")
        now = valid.join(ready, "spec_id", "left_semi")
        if stage == 1:
            now = now.unionByName(refused)
        plan = materialize(decide_transfers(now, state, resolution), "sequence-plan")
        gone = materialize(_gone(plan, now.where("remove_source AND reason IS NULL"), state), "sequence-gone")
        removed = gone.where("method <> 'rename'").select(
            "spec_id",
            F.col("drive_id").alias("source_drive_id"),
            F.col("path").alias("source_path"),
            F.lit("remove").alias("decision"),
            F.lit("delete").alias("method"),
            F.lit(False).alias("replaces"),
            F.lit(2).alias("step"),
        )
        part = plan.withColumn("step", F.lit(1)).unionByName(removed, allowMissingColumns=True)
        part = part.withColumn("stage", F.lit(stage))
        rows = part if rows is None else rows.unionByName(part)
        waiting = materialize(waiting.join(ready, "spec_id", "left_anti"), "sequence-touches")
        if waiting.isEmpty():
            return rows
        state = materialize(_left_by(state, plan, gone, drives, waiting), "sequence-items")
