import itertools

import pytest
from pyspark.sql import functions as F

from stowage.operators import scale, usage as U
from stowage.sources import snapshots as S

SCHEMA = "drive_id int, path string, bytes bigint, created timestamp"


def usage(spark, rows):
    text = spark.createDataFrame(rows, "drive_id int, path string, bytes bigint, created string")
    return text.withColumn("created", F.col("created").cast("timestamp"))


RUNS = [
    (1, "old/x", 5, "2024-01-01 00:00:00"),
    (1, U.COMPLETED_MARKER, 0, "2024-01-01 00:00:10"),
    (1, "edge", 7, "2024-01-01 01:00:00"),  # exactly a minute before the marker
    (1, "a/b/1", 10, "2024-01-01 01:00:30"),
    (1, "a/2", 20, "2024-01-01 01:00:40"),
    (1, "a_b/3", 40, "2024-01-01 01:00:40"),
    (1, U.COMPLETED_MARKER, 0, "2024-01-01 01:01:00"),
    (1, "newer", 80, "2024-01-01 02:00:00"),
    (2, "never/closed", 1, "2024-01-01 00:00:00"),
]


def test_visible_run(spark):
    got = {r.path for r in U.current_usage(usage(spark, RUNS)).collect()}
    assert got == {"a/b/1", "a/2", "a_b/3", "newer"}


def test_folder_totals(spark):
    df = usage(spark, RUNS)
    total = lambda drive, path: U.folder_usage_total(df, drive, path).first()["bytes"]
    assert total(1, "/") == 150
    assert total(1, "a/") == 30
    assert total(1, "a_") == 40  # no wildcard
    assert total(2, "/") is None
    assert {r.path: r.bytes for r in U.subfolder_usage(df, 1, "/").collect()} == {"a/": 30, "a_b/": 40}
    assert {r.path: r.bytes for r in U.subfolder_usage(df, 1, "a").collect()} == {"a/b/": 10}


def test_rollup_equals_single_totals_and_drive_total(spark):
    df = usage(spark, RUNS)
    rolled = {(r.drive_id, r.folder): (r.bytes, r.files) for r in U.usage_rollup(df).collect()}
    assert rolled == {(1, "/"): (150, 4), (1, "a/"): (30, 2), (1, "a/b/"): (10, 1), (1, "a_b/"): (40, 1)}
    root = U.drive_totals(U.current_usage(df)).first()
    assert rolled[(1, "/")][0] == root["bytes"]


def test_biggest_files(spark):
    got = [(r.path, r.bytes) for r in U.biggest_files(usage(spark, RUNS), 1, "/", 2).collect()]
    assert got == [("newer", 80), ("a_b/3", 40)]


def test_retention_boundary(spark):
    flags = {(r.drive_id, r.path, str(r.created)): r.expired for r in U.retention_flags(usage(spark, RUNS)).collect()}
    gone = {k[1] for k, v in flags.items() if v}
    assert gone == {"old/x", U.COMPLETED_MARKER}
    kept = U.expire_snapshots(usage(spark, RUNS))
    assert kept.where("path = 'edge'").count() == 1 and kept.where("drive_id = 2").count() == 1


def history(spark, n, drive=1):
    rows = [(drive, i, f"2024-01-01 00:{i:02d}:00") for i in range(n)]
    df = spark.createDataFrame(rows, "drive_id int, bytes bigint, created string")
    return df.withColumn("created", F.col("created").cast("timestamp"))


def sampled(n, k):
    """The picks of the sampling, step by step."""
    if n <= k:
        return list(range(n))
    stride = n // k
    place = (n - 1) - (k - 1) * stride
    picks = [place + i * stride for i in range(k)]
    picks[0] = 0
    return picks


@pytest.mark.parametrize("n,k,want", [
    (9, 5, [0, 5, 6, 7, 8]), (10, 5, [0, 3, 5, 7, 9]), (11, 5, [0, 4, 6, 8, 10]), (11, 1, [0]),
    (5, 5, [0, 1, 2, 3, 4]), (3, 5, [0, 1, 2]),
])
def test_sampling(spark, n, k, want):
    assert sampled(n, k) == want
    got = U.usage_history(history(spark, n), k=k)
    assert sorted(r["bytes"] for r in got.collect()) == want


def test_sampling_of_many_drives(spark):
    counts = {drive: 3 * drive + 1 for drive in range(1, 15)}
    df = history(spark, 1, 0)
    for drive, n in counts.items():
        df = df.unionByName(history(spark, n, drive))
    got = {}
    for r in U.usage_history(df, k=4).collect():
        got.setdefault(r.drive_id, []).append(r["bytes"])
    for drive, n in counts.items():
        assert sorted(got[drive]) == sampled(n, 4)


def test_history_range(spark):
    df = history(spark, 10)
    inside = U.history_range(df, "2024-01-01 00:02:00", "2024-01-01 00:04:00")
    assert sorted(r["bytes"] for r in inside.collect()) == [2, 3, 4]
    assert U.history_range(df, None, "1970-01-01 00:00:00").count() == 10  # means now
    assert U.history_range(df).count() == 10
    assert U.history_range(df, "2024-01-01 00:05:00", "2024-01-01 00:01:00").count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 8, 64])
def test_running_total_with_one_hot_group(spark, buckets):
    rows = [("hot" if i % 3 else f"g{i % 7}", f"k{i * 7919 % 1000:04d}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k string, v bigint")
    got = scale.running_total(df, ["g"], ["k"], F.col("v"), "run", "all", buckets).collect()
    assert len(got) == 1000
    want, totals = {}, {}
    for g, members in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        run = 0
        for _, k, v in members:
            run += v
            want[(g, k)] = run
        totals[g] = run
    assert {(r.g, r.k): r["run"] for r in got} == want
    assert all(r["all"] == totals[r.g] for r in got)


def test_hot_group_is_cut_into_ranges(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    out = scale.running_position(df, ["g"], ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [sum(1)" in line]
    assert windows and all("_bucket" in line for line in windows)
    assert "Join Cross" not in plan


def test_small_side_check(spark):
    assert scale.fits_broadcast(spark.range(100), max_rows=100)
    assert not scale.fits_broadcast(spark.range(101), max_rows=100)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert not scale.fits_broadcast(wide, max_bytes=9_999)
    assert scale.fits_broadcast(wide, max_bytes=10_000)


def test_snapshot_runs_history_and_purge(spark, folder):
    drives = spark.createDataFrame([(1,), (2,)], "drive_id int")
    items = spark.createDataFrame([(1, "a/x", 3), (1, "b", 4)], "drive_id int, path string, file_size bigint")
    path = f"{folder}/usage"
    S.append_snapshot(items, drives, "2024-01-01 00:00:00", path)
    S.append_snapshot(items.where("path = 'b'"), drives, "2024-01-01 01:00:00", path)
    usage = S.read_usage(spark, path)
    assert usage.count() == 7
    now = U.current_usage(usage)
    assert [(r.drive_id, r.path) for r in now.collect()] == [(1, "b")]
    S.append_history(now, drives, "2024-01-01 01:00:00", f"{folder}/history")
    got = {r.drive_id: (r["bytes"], r.path) for r in S.read_history(spark, f"{folder}/history").collect()}
    assert got == {1: (4, "/"), 2: (0, "/")}
    assert S.purge_snapshots(spark, path) == 2
    left = S.read_usage(spark, path)
    assert left.count() == 3 and {r.run for r in left.select("run").distinct().collect()} == {1704070800000000}
    assert S.purge_snapshots(spark, path) == 0


def test_unfinished_run_stays_behind_the_old_one(spark, folder):
    drives = spark.createDataFrame([(1,)], "drive_id int")
    items = spark.createDataFrame([(1, "a", 3)], "drive_id int, path string, file_size bigint")
    S.append_snapshot(items, drives, "2024-01-01 00:00:00", f"{folder}/u")
    rows = S._rows(items.withColumn("path", F.lit("late")), "2024-01-01 01:00:00")
    rows.write.mode("append").partitionBy("drive_id", "run").parquet(f"{folder}/u")
    usage = S.read_usage(spark, f"{folder}/u")
    assert {r.path for r in U.current_usage(usage).collect()} == {"a", "late"}
    assert S.expired_runs(usage).count() == 0


def test_filter_reaches_the_usage_scan(spark, folder):
    usage(spark, RUNS).write.parquet(f"{folder}/u")
    df = U.folder_usage_total(spark.read.parquet(f"{folder}/u"), 1, "a/")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a/)" in plan and "EqualTo(drive_id,1)" in plan
    assert "Join" not in plan


def test_scratch_folder_without_a_shared_one():
    from types import SimpleNamespace

    from stowage.session import shared_folder

    def session(master, application, base=None):
        context = SimpleNamespace(master=master, applicationId=application)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: base or default), sparkContext=context)

    local = session("local[2]", "app-x")
    one, two = shared_folder(local, "a"), shared_folder(local, "a")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    assert shared_folder(session("yarn", "app-y", "s3a://b/c/"), "a").startswith("s3a://b/c/a-")
    with pytest.raises(ValueError):
        shared_folder(session("yarn", "app-y"), "a")


def test_old_runs_are_not_read(spark, folder):
    drives = spark.createDataFrame([(1,), (2,)], "drive_id int")
    items = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "drive_id int, path string, file_size bigint")
    for hour in range(4):
        S.append_snapshot(items, drives, f"2024-01-01 0{hour}:00:00", f"{folder}/u")
    usage = S.read_usage(spark, f"{folder}/u")
    for df, total in ((U.current_usage(usage).agg(F.sum("bytes")), 7), (U.folder_usage_total(usage, 1, "/"), 3)):
        assert df.first()[0] == total
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("PartitionFilters" in line and "run" in line.split("PartitionFilters")[1].split("]")[0]
                   for line in plan.splitlines() if "FileScan" in line)


def test_reader_and_writer_in_different_zones(spark, folder):
    drives = spark.createDataFrame([(1,)], "drive_id int")
    first = spark.createDataFrame([(1, "a", 3)], "drive_id int, path string, file_size bigint")
    second = spark.createDataFrame([(1, "b", 4)], "drive_id int, path string, file_size bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for n, writer in enumerate(("UTC", "Asia/Tokyo", "America/New_York")):
            spark.conf.set("spark.sql.session.timeZone", writer)
            path = f"{folder}/u{n}"
            # the first of these lies in the hour that New York has twice
            S.append_snapshot(first, drives, "2024-11-03 01:30:00", path)
            S.append_snapshot(second, drives, "2024-11-03 02:10:00", path)
            for reader in ("UTC", "Asia/Tokyo", "America/New_York"):
                spark.conf.set("spark.sql.session.timeZone", reader)
                usage = S.read_usage(spark, path)
                assert [r.path for r in U.current_usage(usage).collect()] == ["b"]
                assert U.folder_usage_total(usage, 1, "/").first()[0] == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_running_total_keeps_null_groups(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", None, 2)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint")
    got = scale.running_total(df, ["g"], ["k"], F.col("v"), "sum", "all").collect()
    assert {(r.g, r.k): (r["sum"], r["all"]) for r in got} == {
        (None, 1): (5, 12), (None, 2): (12, 12), ("a", None): (2, 3), ("a", 1): (3, 3)
    }
