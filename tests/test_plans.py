import pytest
from pyspark.sql import functions as F

from stowage.operators import lookup
from stowage.plans import archive, expiry, removal, requests, transfer

ITEM = "drive_id int, path string, file_size bigint, directory boolean, storage_class string"
SPEC = (
    "spec_id int, source_drive_id int, source_path string, dest_drive_id int, dest_path string,"
    " remove_source boolean"
)
RULE = (
    "drive_id int, rule_id int, rule_text string, exclude boolean, access_level string,"
    " users string, role_name string"
)


@pytest.fixture(scope="module")
def world(spark):
    items = [
        (1, "a/one", 5, False, "STANDARD"), (1, "a/b/two", 0, False, "STANDARD"),
        (1, "a/b/three", 7, False, "STANDARD_IA"), (1, "a/", 0, True, None), (1, "a/b/", 0, True, None),
        (1, "ab/four", 9, False, "STANDARD"), (1, "a.zip", 3, False, "STANDARD"),
        (1, "cold/x", 4, False, "GLACIER"), (1, "cold/y", 4, False, "STANDARD"),
        (1, "secret/s", 1, False, "STANDARD"),
        (2, "in/one", 8, False, "HOT"), (2, "in/b/other", 8, False, "ARCHIVE"), (3, "w", 1, False, None),
    ]
    rules = [(d, 1, ".*", False, "D", "", "") for d in (1, 2, 3)]
    rules += [(1, 2, "secret/.*", True, "D", "", ""), (2, 3, ".*", False, "A", "", ""),
              (1, 4, "(a|cold)/.*", False, "U", "", ""), (3, 5, ".*", False, "A", "", ""),
              (1, 6, "a/.*", False, "A", "", ""), (2, 7, ".*", False, "U", "", ""), (3, 8, ".*", False, "U", "", "")]
    return {
        "items": spark.createDataFrame(items, ITEM),
        "drives": spark.createDataFrame(
            [(1, "one", "S3"), (2, "two", "Blob"), (3, "three", "Windows")],
            "drive_id int, display_name string, drive_type string",
        ),
        "rules": spark.createDataFrame(rules, RULE),
    }


def plan(spark, world, specs, resolution="cancel"):
    df = transfer.transfer_plan(
        spark.createDataFrame(specs, SPEC), world["items"], world["drives"], world["rules"], "ann",
        (), resolution,
    )
    out = {}
    for r in df.collect():
        key = r.reason or (r.decision if r.decision == "skip" else r.method)
        out.setdefault(r.spec_id, set()).add((r.source_path, r.dest_path, key, r.replaces))
    return out


def test_refusals(spark, world):
    specs = [
        (1, 9, "a/one", 2, "x", False), (2, 1, "a/one", 9, "x", False), (3, 1, "a/one", 2, None, False),
        (4, 1, None, 2, "x", False), (5, 1, "a/one", 1, "a/one", False), (6, 1, "a/", 1, "a", False),
        (7, 1, "a/", 1, "a/c/", True), (8, 1, "secret/s", 2, "s", False), (9, 1, "a/one", 1, "secret/n", False),
        (10, 1, "nothing", 2, "n", False), (11, 1, "nothing/", 2, "n", False), (12, 1, "cold/", 2, "c/", False),
        (13, 1, "cold/x", 2, "c", False), (14, 1, "a/one", 2, "in/one", False), (15, 1, "a/", 2, "in/", False),
    ]
    got = {k: {(key, dest) for _, dest, key, _ in v} for k, v in plan(spark, world, specs).items()}
    assert got == {
        1: {("no source drive", "x")}, 2: {("no destination drive", "x")}, 3: {("no destination path", None)},
        4: {("no source path", "x")}, 5: {("same source and destination", "a/one")},
        6: {("same source and destination", "a")}, 7: {("moved beneath itself", "a/c/")},
        8: {("no permission", "s")}, 9: {("no permission", "secret/n")}, 10: {("source not found", "n")},
        11: {("source not found", "n")}, 12: {("archived", "c/")}, 13: {("archived", "c")},
        14: {("destination exists", "in/one")}, 15: {("destination exists", "in/")},
    }


def test_methods_and_expansion(spark, world):
    specs = [
        (1, 1, "a/", 1, "z", False), (2, 1, "/a", 2, "/new/", True), (3, 1, "a/one", 1, "q", True),
        (4, 1, "a/one", 1, "q4", False), (5, 1, "a/one", 3, "q", True), (6, 1, "a/b/two", 3, "q6", True),
        (7, 1, "a.zip", 1, "b.zip", False),
    ]
    assert plan(spark, world, specs) == {
        1: {("a/one", "z/one", "copy", False), ("a/b/", "z/b/", "mkdir", False),
            ("a/b/two", "z/b/two", "empty", False), ("a/b/three", "z/b/three", "copy", False)},
        2: {("a/one", "new/one", "chunk", False), ("a/b/", "new/b/", "mkdir", False),
            ("a/b/two", "new/b/two", "empty", False), ("a/b/three", "new/b/three", "chunk", False)},
        3: {("a/one", "q", "rename", False)}, 4: {("a/one", "q4", "copy", False)},
        5: {("a/one", "q", "chunk", False)}, 6: {("a/b/two", "q6", "empty", False)},
        7: {("a.zip", "b.zip", "copy", False)},
    }


def test_conflicts(spark, world):
    specs = [(1, 1, "a/", 2, "in/", False)]
    rest = {("a/b/", "in/b/", "mkdir", False), ("a/b/two", "in/b/two", "empty", False),
            ("a/b/three", "in/b/three", "chunk", False)}
    assert plan(spark, world, specs, "skip") == {1: rest | {("a/one", "in/one", "skip", False)}}
    assert plan(spark, world, specs, "overwrite") == {1: rest | {("a/one", "in/one", "chunk", True)}}
    with pytest.raises(ValueError):
        plan(spark, world, specs, "ask")


def test_counts_and_archived(spark, world):
    specs = spark.createDataFrame(
        [(1, 1, "a/", 2, "x", False), (2, 1, "a/one", 2, "x", False), (3, 1, "a", 2, "x", False),
         (4, 1, "gone/", 2, "x", False), (5, 1, "gone", 2, "x", False), (6, 1, "/", 2, "x", False),
         (7, 1, "cold/", 2, "x", False), (8, 2, "in/b/", 1, "x", False)], SPEC,
    )
    got = {r.spec_id: r["items"] for r in transfer.transfer_counts(specs, world["items"]).collect()}
    assert got == {1: 4, 2: 1, 3: 4, 4: 0, 5: 1, 6: 10, 7: 2, 8: 1}
    cold = transfer.any_archived(specs, world["items"], world["drives"]).collect()
    assert {r.spec_id: r.any_archived for r in cold} == {1: False, 2: False, 3: False, 6: True, 7: True, 8: True}


def test_expansion_is_the_same_with_and_without_broadcast(spark, world):
    asked = spark.createDataFrame([(1, 1, "a"), (2, 1, "/"), (3, 1, "ab/"), (4, 2, "in")],
                                  "request_id int, drive_id int, path string")
    both = [
        {(r.request_id, r.item_path, r.in_folder, r.is_self)
         for r in requests.expand(asked, world["items"], small=small).collect()}
        for small in (True, False)
    ]
    assert both[0] == both[1]
    assert {p for i, p, *_ in both[0] if i == 1} == {"a/", "a/one", "a/b/", "a/b/two", "a/b/three"}
    assert {p for i, p, *_ in both[0] if i == 3} == {"ab/four"}
    assert len({p for i, p, *_ in both[0] if i == 2}) == 10


def test_rename(spark, world):
    specs = spark.createDataFrame(
        [(1, 1, "a/", 1, "z/", False), (2, 1, "a/one", 1, "a/b", False), (3, 1, "a/one", 2, "n", False),
         (4, 1, "secret/s", 1, "n", False), (5, 1, "gone", 1, "n", False), (6, 1, "a/one", 1, "a/uno", False),
         (7, 1, "a/one", 1, "ab/four", False)], SPEC,
    )
    rows = transfer.rename_plan(specs, world["items"], world["drives"], world["rules"], "ann").collect()
    got = {}
    for r in rows:
        got.setdefault(r.spec_id, set()).add((r.old_path, r.new_path) if r.decision == "rename" else r.reason)
    assert got == {
        1: {("a/", "z/"), ("a/one", "z/one"), ("a/b/", "z/b/"), ("a/b/two", "z/b/two"), ("a/b/three", "z/b/three")},
        2: {"destination exists"}, 3: {"across drives"}, 4: {"no permission"}, 5: {"source not found"},
        6: {"source not found"}, 7: {"destination exists"},  # the first spec has taken a/one along
    }


def test_an_item_is_renamed_once(spark, world):
    specs = spark.createDataFrame(
        [(3, 1, "a/", 1, "z/", False), (1, 1, "a/b/", 1, "x/", False), (2, 1, "a/b/", 1, "y/", False)], SPEC)
    rows = transfer.rename_plan(specs, world["items"], world["drives"], world["rules"], "ann").collect()
    assert sorted((r.spec_id, r.old_path, r.reason or r.new_path) for r in rows) == [
        (1, "a/b/", "x/"), (1, "a/b/three", "x/three"), (1, "a/b/two", "x/two"), (2, "a/b/", "source not found"),
        (3, "a/", "z/"), (3, "a/one", "z/one"),
    ]


def test_delete(spark, world):
    asked = spark.createDataFrame([(1, 1, "a/"), (2, 1, "secret/s"), (3, 1, "gone"), (4, 1, "a.zip"), (5, 1, "a")],
                                  "request_id int, drive_id int, path string")
    rows = removal.delete_plan(asked, world["items"], world["rules"], "ann").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.ordinal or 0):
        got.setdefault(r.request_id, []).append(r.path if r.decision == "delete" else r.reason)
    in_order = ["a/b/three", "a/b/two", "a/one", "a/b/", "a/"]
    assert got == {1: in_order, 2: ["no permission"], 3: ["not found"], 4: ["a.zip"], 5: [None] * 5}
    assert sorted(r.ordinal for r in rows if r.request_id == 1) == [1, 2, 3, 4, 5]


def test_storage_class(spark, world):
    asked = spark.createDataFrame(
        [(1, 2, "in/one", "COOL"), (2, 2, "in/one", "GLACIER"), (3, 1, "ab/four", "GLACIER"), (4, 3, "w", "HOT"),
         (5, 2, "gone", "HOT"), (6, 9, "w", "HOT"), (7, 1, "a/one", "GLACIER")],
        "request_id int, drive_id int, path string, new_class string",
    )
    rows = archive.storage_class_plan(asked, world["items"], world["drives"], world["rules"], "ann").collect()
    assert {r.request_id: (r.old_class, r.decision, r.reason) for r in rows} == {
        1: ("HOT", "change", None), 2: ("HOT", "reject", "unknown storage class"),
        3: ("STANDARD", "reject", "no permission"), 4: (None, "reject", "not a cloud drive"),
        5: (None, "reject", "not found"), 6: (None, "reject", "no drive"), 7: ("STANDARD", "change", None),
    }


def test_restore(spark, world):
    asked = spark.createDataFrame([(1, 1, "cold/"), (2, 2, "in/"), (3, 1, "ab/"), (4, 3, "w"), (5, 1, "a/one")],
                                  "request_id int, drive_id int, path string")

    def chosen(items):
        rows = archive.restore_plan(asked, items, world["drives"], world["rules"], "ann").collect()
        got = {}
        for r in rows:
            got.setdefault(r.request_id, set()).add(r.path if r.decision == "restore" else r.reason)
        return got

    refused = {3: {"no permission"}, 4: {"not a restorable drive"}, 5: {"a/one"}}
    assert chosen(world["items"]) == {1: {"cold/x"}, 2: {"in/b/other"}, **refused}
    busy = world["items"].withColumn("is_restoring", F.col("path") == "cold/x")
    assert chosen(busy) == {2: {"in/b/other"}, **refused}


def test_expiry(spark):
    hours = [(1, "tmp_a", 100, 30), (1, "TMP_b", 10, 13), (1, "x/tmp_c", 5, 7), (1, "tmp_d", 2, 2),
             (1, "tmp_e", 1, 0), (1, "Tmp_f", 999, 99), (1, "other", 999, 99)]
    items = spark.createDataFrame(hours, "drive_id int, path string, file_size bigint, age int").selectExpr(
        "drive_id", "path", "file_size",
        "timestamp '2024-01-10 12:00:00' - make_interval(0, 0, 0, 0, age) AS modified_date",
    )

    def dropped(free, need):
        table = spark.createDataFrame([(1, free, need)], "drive_id int, free_bytes bigint, need_bytes bigint")
        rows = expiry.expiry_plan(items, table, "2024-01-10 12:00:00", "tmp_").collect()
        return {r.path for r in rows}, {r.cutoff_hours for r in rows}, {r.sufficient for r in rows}

    assert dropped(50, 50) == (set(), set(), set())
    assert dropped(0, 100) == ({"tmp_a"}, {24}, {True})
    assert dropped(0, 110) == ({"tmp_a", "TMP_b"}, {12}, {True})
    assert dropped(1, 116) == ({"tmp_a", "TMP_b", "x/tmp_c"}, {6}, {True})
    assert dropped(0, 117) == ({"tmp_a", "TMP_b", "x/tmp_c", "tmp_d"}, {1}, {True})
    assert dropped(0, 118) == ({"tmp_a", "TMP_b", "x/tmp_c", "tmp_d"}, {1}, {False})
    assert dropped(0, 119) == (set(), set(), set())
    young = expiry.temp_space(items, "tmp_", "2024-01-10 12:00:00", 420).first()
    assert (young["bytes"], young.files) == (115, 3)


def test_lookups(spark, world):
    asked = spark.createDataFrame(
        [(1, 1, "a/ONE"), (1, 1, "a/none"), (2, 1, "a/none"), (3, 1, "A"), (4, 2, "IN/b"), (5, 2, "in/B"), (6, 1, "a/one/")],
        "request_id int, drive_id int, path string",
    )
    got = {r.request_id: r.any_exists for r in lookup.any_exists(world["items"], asked).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    paths = ["a/one", "/a/one", "a/one/", "a", "a/", "/a/b", "in", "cold", "a/on"]
    asked = spark.createDataFrame([(i, 1, p) for i, p in enumerate(paths)], "request_id int, drive_id int, path string")
    got = {r.path: r.exists for r in lookup.path_exists(world["items"], asked).collect()}
    assert got == dict(zip(paths, [True, True, False, True, True, True, False, True, False]))
    found = {r.request_id: r.path for r in lookup.get_items(world["items"], asked).collect()}
    assert found == {0: "a/one", 1: "a/one", 2: "a/one", 3: "a/", 4: "a/", 5: "a/b/"}


def test_one_destination_for_two_sources(spark, world):
    specs = [(1, 1, "a/one", 1, "z/x", False), (2, 1, "ab/four", 1, "/z/x", False)]
    first = {("a/one", "z/x", "copy", False)}
    assert plan(spark, world, specs) == {1: first, 2: {("ab/four", "/z/x", "destination exists", False)}}
    assert plan(spark, world, specs, "skip") == {1: first, 2: {("ab/four", "/z/x", "skip", False)}}
    assert plan(spark, world, specs, "overwrite") == {1: first, 2: {("ab/four", "/z/x", "copy", True)}}
    named = transfer.rename_plan(
        spark.createDataFrame(specs, SPEC), world["items"], world["drives"], world["rules"], "ann"
    )
    assert {r.spec_id: (r.decision, r.reason) for r in named.collect()} == {
        1: ("rename", None), 2: ("reject", "destination exists")
    }


@pytest.mark.parametrize(
    "source, dest", [("a/", "a/sub/"), ("/a/", "a/sub/"), ("a", "/a/sub"), ("a", "a/sub/"), ("a/", "/a/sub")]
)
def test_moved_beneath_itself_in_any_spelling(spark, world, source, dest):
    got = plan(spark, world, [(1, 1, source, 1, dest, True)])
    assert {key for _, _, key, _ in got[1]} == {"moved beneath itself"}


def test_overlapping_deletes(spark, world):
    asked = spark.createDataFrame(
        [(1, 1, "a/b/"), (2, 1, "a/"), (3, 1, "a/b/two"), (4, 1, "a/b/two")],
        "request_id int, drive_id int, path string",
    )
    got = removal.delete_plan(asked, world["items"], world["rules"], "ann").collect()
    deleted = [r.path for r in got if r.decision == "delete"]
    assert sorted(deleted) == ["a/", "a/b/", "a/b/three", "a/b/two", "a/one"]
    assert {(r.request_id, r.path) for r in got if r.decision == "covered"} == {
        (2, "a/b/"), (2, "a/b/two"), (2, "a/b/three"), (3, "a/b/two"), (4, "a/b/two")
    }
    assert {r.request_id: r.ordinal for r in got if r.path == "a/" and r.decision == "delete"} == {2: 2}
