"""Batches of transfers against the same requests carried out one after another."""

import random

import pytest

from stowage.plans import sequence

ITEM = "drive_id int, path string, file_size bigint, directory boolean, storage_class string, spec_id int"
SPEC = (
    "spec_id int, source_drive_id int, source_path string, dest_drive_id int, dest_path string,"
    " remove_source boolean"
)
RULE = (
    "drive_id int, rule_id int, rule_text string, exclude boolean, access_level string,"
    " users string, role_name string"
)


WORLDS = 20


def world(spark):
    numbers = range(1, WORLDS * 2 + 1)
    drives = spark.createDataFrame(
        [(d, f"drive {d}", "S3" if d == 1 else "Windows") for d in numbers],
        "drive_id int, display_name string, drive_type string",
    )
    rules = spark.createDataFrame([(d, 1, ".*", False, "D", "", "") for d in numbers], RULE)
    return drives, rules


def run(spark, items, specs, resolution="cancel"):
    drives, rules = world(spark)
    rows = [(d, p, n, p.endswith("/"), c, 0) for d, p, n, c in items]
    return sequence.transfer_sequence(
        spark.createDataFrame(specs, SPEC), spark.createDataFrame(rows, ITEM), drives, rules, "ann", (), resolution
    ).collect()


def folders(tree, drive):
    return {p[: i + 1] for d, p in tree if d == drive for i, c in enumerate(p) if c == "/"}


def one_by_one(items, specs, resolution):
    """(tree, reason by spec): each request on the tree the one before it left."""
    tree = {(d, p): (n, c) for d, p, n, c in items}
    reasons = {}
    for spec, source_drive, source, dest_drive, dest, move in sorted(specs, key=lambda s: s[0]):
        bare, to = source.strip("/"), dest.strip("/")
        if source_drive == dest_drive and (source in (dest, dest + "/")):
            reasons[spec] = "same source and destination"
            continue
        if move and source_drive == dest_drive and (not bare or to.startswith(bare + "/")):
            reasons[spec] = "moved beneath itself"
            continue
        inside = sorted(p for d, p in tree if d == source_drive and p.startswith(bare + "/") and p != bare + "/")
        exact = [bare] if not source.endswith("/") and (source_drive, bare) in tree else []
        pairs = [(p, dest) for p in exact] + [(p, to + p[len(bare):]) for p in inside]
        if not pairs:
            reasons[spec] = "source not found"
            continue
        if any(tree[source_drive, p][1] == "GLACIER" and source_drive == 1 for p, _ in pairs):
            reasons[spec] = "archived"
            continue

        def there(drive, key):
            key = key.strip("/")
            return (drive, key) in tree or key + "/" in folders(tree, drive)

        clash = {p for p, q in pairs if not p.endswith("/") and there(dest_drive, q)}
        if resolution == "cancel" and (clash or (inside and there(dest_drive, dest))):
            reasons[spec] = "destination exists"
            continue
        skipped = clash if resolution == "skip" else set()
        default = "STANDARD" if dest_drive == 1 else None
        new = {
            (dest_drive, q.strip("/") + ("/" if p.endswith("/") else "")): (tree[source_drive, p][0], default)
            for p, q in pairs if p not in skipped
        }
        if move:
            own = [bare + "/"] if inside and (source_drive, bare + "/") in tree else []
            for p in [p for p, _ in pairs if p not in skipped] + own:
                if not (p.endswith("/") and any(s.startswith(p) for s in skipped)):
                    tree.pop((source_drive, p))
        tree |= new
    return {k: v[0] for k, v in tree.items()}, reasons


def carried_out(items, rows):
    """The tree once the stages have been carried out, each step from what it found."""
    tree = {(d, p): n for d, p, n, _ in items}
    for stage in sorted({r.stage for r in rows}):
        part = [r for r in rows if r.stage == stage]
        writes, renamed = {}, []
        for r in part:
            if r.decision == "transfer":
                place = r.dest_path.strip("/") + ("/" if r.method == "mkdir" else "")
                assert (r.source_drive_id, r.source_path) in tree
                writes[r.dest_drive_id, place] = tree[r.source_drive_id, r.source_path]
                if r.method == "rename":
                    renamed.append((r.source_drive_id, r.source_path))
        for key in renamed:
            tree.pop(key)
        tree |= writes
        for r in part:
            if r.decision == "remove":
                assert r.step == 2
                tree.pop((r.source_drive_id, r.source_path))
    return tree


ITEMS = [
    (1, "a/one", 5, "STANDARD"), (1, "a/b/two", 0, "STANDARD"), (1, "a/b/", 0, None), (1, "a/", 0, None),
    (1, "z/one", 6, "STANDARD"), (1, "cold/x", 4, "GLACIER"), (2, "in/one", 8, None),
]


def test_later_requests_see_what_earlier_ones_did(spark):
    specs = [
        (1, 1, "a/", 2, "new/", True),       # takes a/ away
        (2, 1, "a/one", 1, "late", False),   # is gone
        (3, 2, "new/one", 2, "again", False),  # is there
        (4, 1, "z/", 1, "a/", True),         # the freed name is free
        (5, 2, "in/one", 2, "new/one", False),  # taken by the first
        (6, 1, "cold/", 2, "warm/", True),
        (7, 2, "in/one", 2, "in/one", True),
    ]
    rows = run(spark, ITEMS, specs)
    reasons = {r.spec_id: r.reason for r in rows if r.reason}
    assert reasons == {
        2: "source not found", 5: "destination exists", 6: "archived", 7: "same source and destination"
    }
    stages = {r.spec_id: r.stage for r in rows}
    assert stages == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 1, 7: 1}
    removed = {(r.spec_id, r.source_path) for r in rows if r.decision == "remove"}
    assert removed == {(1, "a/one"), (1, "a/b/two"), (1, "a/b/"), (1, "a/"), (4, "z/one")}
    assert carried_out(ITEMS, rows) == {
        (2, "new/one"): 5, (2, "new/b/two"): 0, (2, "new/b/"): 0, (2, "again"): 5, (1, "a/one"): 6,
        (1, "cold/x"): 4, (2, "in/one"): 8,
    }


def random_world(pick, drives):
    """Items and requests on two drives."""
    names = ["a/", "a/b/", "c/", "c/d/", "e/"]
    files = sorted({(pick.choice(drives), f + pick.choice("xyz")) for f in names for _ in range(4)})
    items = [(d, p, n + 1, None) for n, (d, p) in enumerate(files)]
    places = names + ["a/x", "c/y", "c/d/z", "n/", "n/x"]
    asked = []
    for _ in range(7):
        source, dest = pick.choice(places), pick.choice(places)
        if source.endswith("/") != dest.endswith("/"):
            dest = dest.strip("/") + ("/" if source.endswith("/") else "")
        asked.append((pick.choice(drives), source, pick.choice(drives), dest, pick.random() < 0.5))
    # a copy into its own folder reads what it writes; a move into a folder above itself likewise
    return items, [
        s for s in asked if s[0] != s[2] or not (s[1].startswith(s[3]) or s[3].startswith(s[1]))
    ]


@pytest.mark.parametrize("resolution", ["cancel", "skip", "overwrite"])
def test_same_tree_as_one_after_another(spark, resolution):
    pick = random.Random(resolution)
    worlds = [random_world(pick, (n, n + 1)) for n in range(1, WORLDS * 2, 2)]
    items = [i for world, _ in worlds for i in world]
    # the requests of all worlds mixed into one batch
    specs = [s for _, asked in worlds for s in asked]
    pick.shuffle(specs)
    specs = [(n, *s) for n, s in enumerate(specs)]
    rows = run(spark, items, specs, resolution)
    tree, reasons = one_by_one(items, specs, resolution)
    assert {r.spec_id: r.reason for r in rows if r.reason} == reasons
    assert carried_out(items, rows) == tree


def test_odd_batches(spark):
    assert run(spark, ITEMS, []) == []
    assert [r.reason for r in run(spark, [], [(1, 1, "a/", 2, "b/", None)])] == ["source not found"]
    rows = run(spark, ITEMS, [(1, 99, None, 2, "b/", True), (2, 1, None, 2, "b/", None), (3, 1, "a/", 2, "q/", None)])
    assert {r.spec_id: r.reason for r in rows} == {1: "no source drive", 2: "no source path", 3: None}
    assert {r.decision for r in rows if r.spec_id == 3} == {"transfer"}
    with pytest.raises(ValueError):
        run(spark, ITEMS, [], "ask")
