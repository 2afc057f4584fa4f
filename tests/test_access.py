import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.operators import access as A

RULE_SCHEMA = (
    "drive_id int, rule_id int, rule_text string, exclude boolean, access_level string,"
    " users string, role_name string"
)


def rules(spark, *given):
    rows = [(1, i, *(list(g) + [""] * (5 - len(g)))) for i, g in enumerate(given)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def items(spark, *paths):
    return spark.createDataFrame([(1, p) for p in paths], "drive_id int, path string")


def allowed(df):
    return sorted(r["path"] for r in df.collect())


def test_include_and_exclude(spark):
    a = items(spark, "a")
    for given, want in [
        ([("a", True, "R")], []), ([("b", True, "R")], []), ([(".*", False, "R")], ["a"]),
        ([(".*", True, "R")], []), ([("b", False, "R")], []), ([("a|b", False, "R")], ["a"]),
        ([(".*", False, "R"), ("a", True, "R")], []), ([], []),
        ([("a", False, None)], []),
    ]:
        assert allowed(A.access_filter(a, rules(spark, *given), "ann")) == want


def test_users_and_roles_must_both_apply(spark):
    a = items(spark, "a")
    for users, role, want in [
        ("ann", "", True), ("bob;ann", "", True), ("Ann", "", False), ("bob", "", False),
        ("", "Readers", True), ("", "writers", False), ("bob", "readers", False), ("ann", "READERS", True),
    ]:
        df = A.access_filter(a, rules(spark, ("a", False, "R", users, role)), "ann", ["readers"])
        assert (df.count() == 1) is want


def test_folders_above_an_included_path_are_readable(spark):
    df = items(spark, "folder/", "fol", "folder/sub/", "folder/sub/x", "other/")
    given = rules(spark, ("folder/sub/.*", False, "D"))
    assert allowed(A.access_filter(df, given, "u")) == ["folder/", "folder/sub/", "folder/sub/x"]
    assert allowed(A.access_filter(df, given, "u", level="D")) == ["folder/sub/", "folder/sub/x"]


def test_patterns_that_cannot_be_joined(spark):
    given = rules(
        spark, (r"(a|b)/\1", False, "R"), (r"(?<x>c)/\k<x>", False, "R"), (r"\Qd.d\E", False, "R"),
        (r"(?i)E", False, "R"), (r"f", False, "R"), (r"(g)\1", True, "R"),
    )
    df = items(spark, "a/a", "a/b", "b/b", "c/c", "d.d", "dxd", "e", "f", "F")
    assert allowed(A.access_filter(df, given, "u")) == ["a/a", "b/b", "c/c", "d.d", "e", "f"]


LEVELS = {"D": "DMCR", "M": "MCR", "C": "CR", "R": "R", "A": "A", "U": "U"}


def in_order(path, given, level):
    """The rules one after the other, the first failing exclude ends it."""
    has = False
    for text, exclude, held in given:
        if level not in LEVELS[held]:
            continue
        match = re.fullmatch(text, path) is not None
        if match and exclude:
            return False
        if match and not exclude:
            has = True
        elif not exclude and text.startswith(path) and path.endswith("/") and level == "R":
            has = True
    return has


@pytest.mark.parametrize("folded", [True, False])
def test_sets_of_rules_equal_rules_in_order(spark, monkeypatch, folded):
    monkeypatch.setattr(A, "_fits_folding", lambda _: folded)
    pool = [("a/.*", False, "D"), (".*x", True, "C"), ("a/b/.*", False, "R"), ("b/.*", False, "M"),
            ("a/y", True, "R"), ("b/(x|y)", False, "A"), (".*", False, "U"), ("a/b/?z?", False, "D"),
            ("a/x|b/y", False, "M"), ("/c/.*", False, "R")]
    paths = ["a/", "a/b/", "a/x", "a/y", "a/b/x", "a/b/z", "b/x", "b/y", "b/", "c", "a/b", "/", "/c/d", "/c/", ""]
    chance = random.Random(3)
    rows, cases = [], {}
    for drive in range(40):
        chosen = chance.sample(pool, chance.randint(0, 5))
        cases[drive] = chosen
        rows += [(drive, i, t, e, lv, "", "") for i, (t, e, lv) in enumerate(chosen)]
    given = spark.createDataFrame(rows, RULE_SCHEMA)
    df = spark.createDataFrame(list(itertools.product(cases, paths)), "drive_id int, path string")
    got = {(r.drive_id, r.path): r.access_levels for r in A.with_access_levels(df, given, "u").collect()}
    names = {"R": "Read", "C": "Create", "M": "Modify", "D": "Delete", "A": "Archive", "U": "Restore"}
    for drive, path in itertools.product(cases, paths):
        held = {lv for lv in "DMCRAU" if in_order(path, cases[drive], lv)}
        top = next((lv for lv in "DMCR" if lv in held), None)
        want = [] if top is None else list("RCMD"[: "RCMD".index(top) + 1])
        want += [lv for lv in "AU" if lv in held]
        assert got[(drive, path)] == [names[lv] for lv in want]
    readable = {(r.drive_id, r.path) for r in A.access_filter(df, given, "u").collect()}
    assert readable == {(d, p) for d, p in itertools.product(cases, paths) if in_order(p, cases[d], "R")}


def test_literal_folders(spark):
    given = ["A/.*", "N/O/x[.]csv", ".*x", "a/b/?", "a/b/*c", "a|b/c", "/a/b/.*", "a/b", "(?i)a/b", r"a/\Qb/c\E"]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select("t", A.literal_folder(F.col("t")).alias("f"))
    assert [r.f for r in rows.collect()] == ["A/", "N/O/", "", "a/", "a/", "", "/a/b/", "a/", "", "a/"]


PATTERNS = [
    "A/.*", "A/F/.*", ".*[.]x17", ".*x17.*", r".*\\.csv", "ab?c", "ab+c/.*", "(ab)c", "(ab)*c", "(ab|c)d", "a|b", "(?i)abc", r"\\Qa.b\\E",
    "[ab]c", "[.]c", "[^.]c", "a{2}b", "a{0,3}", "^ab$", "ab.cd", "a-b_c", "é/ab", "a/b/?", "a/b/*c", r"a\\db", "ab[.]?cd", "[a&&[b]]c", "a.*+b",
    "x+?y", ".*", "", "a b", r"\\/ab", r"x\\x41b", "[]a]b", r"\\bab\\b", "ab$|c", "o[0-9]+[.]csv", "(a(b))c", "ab{1}", "(ab){2}",
]


def test_required_pieces_lose_no_match(spark):
    """Whatever a pattern matches has the piece it is filed under."""
    parts = ["a", "b", "c", "d", "ab", "abc", "cd", "x", "y", "x17", "A", "F", "/", "/", ".", ".csv", "-", "_", " ", "é", "12", "o", "$", "abab"]
    chance = random.Random(8)
    texts = sorted({"".join(chance.choices(parts, k=chance.randint(0, 7))) for _ in range(4000)} | {
        "A/F/x.x17", "x17", "abc", "ababc", "aab", "ab.cd", "a-b_c", "é/ab", "a.b", "a1b", "ab", "xAb", "abd", "o12.csv", "ABC"})
    paths = spark.createDataFrame([(t,) for t in texts], "path string").select("path", A.path_pieces(F.col("path")).alias("pieces"))
    # written as Java reads them; the same to Python but for those Python cannot compile
    given = [p.replace("\\\\", "\\") for p in PATTERNS]
    df = spark.createDataFrame([(p,) for p in given], "t string").where("t <> '[]a]b'")
    pairs = F.broadcast(df.select("t", A.required_piece(F.col("t")).alias("piece"))).crossJoin(paths)
    lost = pairs.where(F.rlike("path", A._full(F.col("t"))) & ~F.array_contains("pieces", F.col("piece")))
    assert [tuple(r) for r in lost.collect()] == []
    piece = {r.t: r.piece for r in df.select("t", A.required_piece(F.col("t")).alias("piece")).collect()}
    assert {t: piece[t] for t in ("A/.*", "A/F/.*", ".*[.]x17", ".*x17.*", "(ab)c", "ab?c", "a b", "o[0-9]+[.]csv", ".*")} == {
        "A/.*": "A/", "A/F/.*": "A/F/", ".*[.]x17": "x17", ".*x17.*": "", "(ab)c": "abc", "ab?c": "", "a b": "a",
        "o[0-9]+[.]csv": "csv", ".*": ""}


def test_many_unanchored_rules_on_one_drive(spark):
    """Tens of thousands of patterns without a folder: no row holds all of them, few are tried on a path."""
    given = spark.range(50_000).select(
        F.lit(1).alias("drive_id"), F.col("id").cast("int").alias("rule_id"),
        F.concat(F.lit(".*[.]x"), F.col("id").cast("string")).alias("rule_text"), (F.col("id") % 2 == 1).alias("exclude"),
        F.lit("R").alias("access_level"), F.lit("").alias("users"), F.lit("").alias("role_name"),
    )
    df = spark.range(20_000).select(F.lit(1).alias("drive_id"), F.concat(F.lit("A/F/o.x"), F.col("id").cast("string")).alias("path"))
    assert A._candidates(df, given).count() == 20_000
    assert A.access_filter(df, given, "u").count() == 10_000
    ids = {r.path: r.rule_ids for r in A.matching_rules(df, given).collect()}
    assert len(ids) == 20_000 and ids["A/F/o.x77"] == [77]


def test_many_rules_on_one_drive(spark):
    text = F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/.*"))
    given = spark.range(50_000).select(
        (F.col("id") % 1 + 1).alias("drive_id"), F.col("id").cast("int").alias("rule_id"), text.alias("rule_text"),
        (F.col("id") % 2 == 1).alias("exclude"), F.lit("R").alias("access_level"),
        F.lit("").alias("users"), F.lit("").alias("role_name"),
    )
    df = spark.range(2_000).select(
        (F.col("id") % 1 + 1).alias("drive_id"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/x")).alias("path")
    )
    held = A.access_filter(df, given, "u")
    assert held.count() == 1_000
    joins = re.findall(r"Join \[(.*?)\], \[", held._jdf.queryExecution().executedPlan().toString())
    assert joins and all("," in keys for keys in joins)
    ids = {r.path: r.rule_ids for r in A.matching_rules(df, given).collect()}
    assert len(ids) == 2_000 and ids["d7/x"] == [7]


def test_items_are_not_shuffled(spark, folder):
    items(spark, "a", "b").write.parquet(f"{folder}/i")
    df = A.access_filter(spark.read.parquet(f"{folder}/i"), rules(spark, ("a", False, "R")), "u")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("folded", [True, False])
def test_a_broken_pattern_fails_and_grants_nothing(spark, monkeypatch, folded):
    monkeypatch.setattr(A, "_fits_folding", lambda _: folded)
    with pytest.raises(Exception, match="a\\)\\(b|REGEX|PATTERN|regexp"):
        A.access_filter(items(spark, "ab"), rules(spark, ("a)(b", False, "R")), "u").collect()


def test_catalog_query(spark):
    """Found by the query, readable, and with the levels held; reading is a rule of its own."""
    files = items(spark, "a/", "a/x.csv", "a/y.txt", "a/b/z.csv", "a/secret.csv", "a/.placeholder", "b/x.csv", None)
    given = rules(
        spark, ("a/.*", False, "C"), ("a/x[.]csv", False, "D"), ("a/secret.*", True, "R"), ("a/b/.*", False, "A"),
        ("b/.*", False, "R", "ann"),
    )

    def seen(user="ann", **wanted):
        df = A.catalog_query(files.withColumn("access_levels", F.lit(1)), given, user, **wanted)
        return {r["path"]: set(r["access_levels"]) for r in df.collect()}

    whole = {"Read", "Create"}
    assert seen(start="a/") == {"a/x.csv": whole | {"Modify", "Delete"}, "a/y.txt": whole}
    assert seen(start="/a", recursive=True, pattern=".*csv") == {
        "a/x.csv": whole | {"Modify", "Delete"}, "a/b/z.csv": whole | {"Archive"}}
    assert seen(start="b", pattern="x.*", on="name") == {"b/x.csv": {"Read"}}
    assert seen("bob", start="b") == {}
    assert seen(start="a", placeholder=True).keys() == {"a/x.csv", "a/y.txt", "a/.placeholder"}
    assert A.catalog_query(files.limit(0), given, "ann", recursive=True).count() == 0
    levels = A.with_access_levels(files, given, "ann")
    readable = A.access_filter(levels, given, "ann")
    got = A.catalog_query(files, given, "ann", recursive=True, placeholder=True)
    assert allowed(got.where("path <> ''")) == allowed(readable.where("path <> ''"))
