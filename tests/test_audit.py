import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowage.operators import audit as A, grid as G
from stowage.sources import snapshots as S

SCHEMA = (
    "action_audit_id bigint, username string, action string, path string, drive_id int, status string,"
    " message string, stack_trace string, use_message boolean, created timestamp"
)


def audits(spark):
    day = dt.datetime(2024, 1, 1, 12)
    rows = [
        (1, "ann", "copy", "task", 1, "P", "m1", "trace", True, day),
        (2, "ann", "copy", "x_y", 12, "S", None, "trace", False, day + dt.timedelta(hours=12)),
        (3, "bob", "move", "x%y", None, "S", "", None, False, day + dt.timedelta(hours=11, minutes=59)),
        (4, "ann", "copy", "task", 2, "P", "m4", None, False, day + dt.timedelta(days=2)),
        (5, "ann", "delete", "z", 3, "E", "m5", None, True, day + dt.timedelta(days=3)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r["action_audit_id"] for r in df.collect()]


@pytest.mark.parametrize("field,operator,value,want", [
    ("message", "contains", "m", [1, 4, 5]), ("message", "doesnotcontain", "m", [3]),
    ("action", "eq", "copy", [1, 2, 4]), ("message", "neq", "m1", [3, 4, 5]),
    ("path", "startswith", "x", [2, 3]), ("path", "endswith", "y", [2, 3]),
    ("message", "isnull", None, [2]), ("message", "isnotnull", None, [1, 3, 4, 5]),
    ("message", "isempty", None, [3]), ("message", "isnotempty", None, [1, 4, 5]),
    ("created", "neq", "2024-01-01", [1, 3]), ("created", "eq", "2024-01-02", [2]),
    ("drive_id", "eq", "12", [2]), ("drive_id", "eq", "no number", []), ("drive_id", "contains", 2, [2, 4]),
    ("path", "contains", "x_", [2, 3]),  # the sign is a wildcard, as in LIKE
])
def test_grid_operators(spark, field, operator, value, want):
    got = G.grid_filter(audits(spark), [G.GridFilter(field, operator, value)])
    assert sorted(ids(got)) == want


def test_grid_drive_filter(spark):
    drives = spark.createDataFrame([(1,), (2,), (12,)], "drive_id int")
    for operator, value, want in [("contains", 2, [2, 4]), ("eq", 1, [1]), ("eq", None, []), ("neq", 1, [2, 4])]:
        got = G.grid_filter(audits(spark), [G.GridFilter("drive.driveId", operator, value)], drives)
        assert sorted(ids(got)) == want
    with pytest.raises(ValueError):
        G.grid_filter(audits(spark), [G.GridFilter("drive.driveId", "eq", 1)])


def test_grid_page_sort_and_total(spark):
    df = audits(spark)
    spec = G.GridSpec("drive.driveId", "asc", 0, 10)
    assert ids(G.grid(df, spec)) == [1, 4, 5, 2, 3]
    assert ids(G.grid(df, G.GridSpec("drive_id", "desc", 0, 10))) == [3, 2, 5, 4, 1]
    assert ids(G.grid(df, G.GridSpec("drive_id", None, 1, 3))) == [4, 5]
    both = [G.GridFilter("action", "eq", "copy"), G.GridFilter("username", "eq", "ann")]
    assert G.grid_total(df, G.GridSpec("created", filters=both)).first()["total"] == 3
    with pytest.raises(ValueError):
        G.grid(df, G.GridSpec("created", filters=[G.GridFilter("path", "like", "x")]))


def test_page_is_a_top_k(spark):
    plan = G.grid(audits(spark), G.GridSpec("created", "asc", 0, 2))._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject" in plan.toString()


def test_recent_masked_and_in_progress(spark):
    recent = A.recent_actions(audits(spark), "ann").collect()
    assert [(r.action_audit_id, r.message, r.stack_trace) for r in recent] == [
        (5, "m5", None), (4, None, None), (2, None, None), (1, "m1", None),
    ]
    assert ids(A.in_progress(audits(spark), "ann")) == [4, 1]
    assert ids(A.recent_actions(audits(spark), "ann", 2)) == [5, 4]


def test_statistics(spark):
    got = A.audit_statistics(audits(spark), "P", "2024-01-01 12:00:00").collect()
    assert [(r.action, r.actions) for r in got] == [("copy", 1)]


def test_latest(spark):
    newest = A.latest_matching(audits(spark), ["username", "action", "status"])
    assert sorted(ids(newest)) == [2, 3, 4, 5]


def test_status_events(spark, folder):
    events = audits(spark).withColumn("updated", F.col("created"))
    S.append_audit(events, f"{folder}/audit")
    done = events.where("action_audit_id = 1").withColumns(
        {"status": F.lit("S"), "updated": F.col("created") + F.expr("INTERVAL 2 SECONDS")}
    )
    S.append_audit(done, f"{folder}/audit")
    state = S.read_audit(spark, f"{folder}/audit")
    assert state.count() == 5
    first = A.with_duration(state.where("action_audit_id = 1")).first()
    assert (first.status, first.duration_ms) == ("S", 2000)


def test_progress(spark):
    rows = [(b, f"p{i}") for b, n in ((1, 3), (2, 8)) for i in range(n)]
    df = A.transfer_progress(spark.createDataFrame(rows, "batch_id int, path string"))
    got = {b: [] for b in (1, 2)}
    for r in df.orderBy("batch_id", "done").collect():
        got[r.batch_id].append(r.percent_complete)
    assert got == {1: [33, 67, 100], 2: [13, 25, 38, 50, 63, 75, 88, 100]}


def test_backslashes_are_plain_characters(spark):
    df = spark.createDataFrame([("C:\\data\\x.csv",), ("C:/data/x.csv",), ("D:\\dat_",)], "path string")

    def found(operator, value):
        return sorted(r.path for r in df.where(G.condition(F.col("path"), operator, value)).collect())

    assert found("contains", "C:\\data") == ["C:\\data\\x.csv"]
    assert found("startswith", "C:\\") == ["C:\\data\\x.csv"]
    assert found("endswith", "\\dat_") == ["D:\\dat_"]
    assert found("doesnotcontain", "\\") == ["C:/data/x.csv"]


def test_created_day_ignores_a_time(spark):
    day, timed = G.created_on("2024-01-01"), G.created_on("2024-01-01T10:15:00")
    df = audits(spark)
    assert df.where(day).count() == df.where(timed).count() == 2
