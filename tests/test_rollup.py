"""Folder totals kept by differences against the full roll-up."""

import glob
import os

from pyspark.sql import functions as F

from stowage.operators import usage as U
from stowage.sources import snapshots as S

FILES = "drive_id int, path string, bytes bigint, drives string"


def files(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], FILES)


def totals(rows):
    out = {}
    for drive, path, size in rows:
        parts = path.strip("/").split("/")[:-1]
        for folder in {"/"} | {"/".join(parts[:n]) + "/" for n in range(1, len(parts) + 1)}:
            bytes_, count = out.get((drive, folder), (0, 0))
            out[drive, folder] = (bytes_ + (size or 0), count + 1)
    return out


def stored(spark, path, under="/"):
    return {(r.drive_id, r.folder): (r.bytes, r.files) for r in S.read_rollup(spark, path, under).collect()}


def parts_of(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/drive_id=*/part=*/*.parquet")}


RUNS = [
    [(1, "a/b/x", 5), (1, "a/y", 7), (1, "z", 1), (2, "q/x", 3), (2, "q/x", 3), (3, "k/k", None)],
    [(1, "a/b/x", 5), (1, "a/y", 9), (1, "n/new", 2), (2, "q/x", 3), (2, "q/x", 3), (3, "k/k", None)],
    [(1, "a/y", 9), (2, "q/x", 3), (2, "q/x", 3), (3, "k/k", 4), (1, U.COMPLETED_MARKER, 0)],
]


def test_three_runs(spark, folder):
    path, before = f"{folder}/totals", files(spark, [])
    for hour, rows in enumerate(RUNS):
        after = files(spark, rows)
        old = parts_of(path)
        changes = U.rollup_changes(before, after)
        S.fold_rollup(changes, f"2024-01-01 0{hour}:00:00", path)
        assert stored(spark, path) == totals([r for r in rows if r[1] != U.COMPLETED_MARKER])
        if hour:  # drive 2 did not change, so its files are the old ones
            kept = {p: t for p, t in old.items() if "drive_id=2/" in p}
            assert kept and kept.items() <= parts_of(path).items()
        now = parts_of(path)
        S.fold_rollup(changes, f"2024-01-01 0{hour}:00:00", path)  # a repeated call changes nothing
        assert stored(spark, path) == totals([r for r in rows if r[1] != U.COMPLETED_MARKER])
        assert parts_of(path) == now
        before = after
    assert stored(spark, path, "/a") == {(1, "a/"): (9, 1)}


def test_changes(spark):
    one, two, _ = [files(spark, r) for r in RUNS]
    got = {(r.drive_id, r.folder): (r.bytes, r.files) for r in U.rollup_changes(one, two).collect()}
    # a file of the root went and one below n/ came: the root has one file less, one more, and three bytes more
    assert got == {(1, "/"): (3, 0), (1, "a/"): (2, 0), (1, "n/"): (2, 1)}
    assert U.rollup_changes(two, two).isEmpty() and U.rollup_changes(one.limit(0), one.limit(0)).isEmpty()


def test_half_finished_fold_is_made_up(spark, folder):
    path = f"{folder}/totals"
    one, two, _ = [files(spark, r) for r in RUNS]
    S.fold_rollup(U.rollup_changes(one.limit(0), one), "2024-01-01 00:00:00", path)
    changes = U.rollup_changes(one, two)
    part = F.pmod(F.xxhash64("folder"), F.lit(S.ROLLUP_PARTS))
    of_root = [r.part for r in spark.sql(f"SELECT pmod(xxhash64('/'), {S.ROLLUP_PARTS}) AS part").collect()]
    S.fold_rollup(changes.where(part == of_root[0]), "2024-01-01 01:00:00", path)  # the part of the root only
    S.fold_rollup(changes, "2024-01-01 01:00:00", path)
    assert stored(spark, path) == totals(RUNS[1])
