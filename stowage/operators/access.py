"""Rule-based access to drives and items.

A drive's rules grant a path when any include rule matches it and no exclude
rule does, so rules are evaluated as two sets and not in order. The rules that apply to one
user are folded into one row per drive; while those rows were measured to be small they are
broadcast, which leaves the items where they are. Beyond that each rule is filed under a piece that its text requires of
a path, a folder or a whole word; the distinct paths are joined with the rules by (drive, piece), and a pattern is
tried on what came out only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import levels, paths, scalars
from .query import query_items
from .scale import fits_broadcast

# Above this many bytes of folded patterns an alternation is also slow to match.
FOLDED_BYTES = 512 * 1024

# Regex features that change meaning when patterns are joined into one alternation:
# groups that are referred to by number or name, open quotes and comment mode.
NOT_JOINABLE = r"\\[0-9kQE]|\(\?<[A-Za-z]|\(\?[a-z]*x|\(\?[a-z]+\)|\\$"


def _full(pattern: Column) -> Column:
    return F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z"))


def rule_match(path: Column, rule_text: Column, exclude: Column) -> Column:
    """Whether a path passes one rule: a match, inverted for an exclude rule."""
    return F.rlike(path, _full(rule_text)) != exclude


def rule_ancestor(path: Column, rule_text: Column) -> Column:
    """Whether the path is a folder that the rule text starts with."""
    return rule_text.startswith(path) & path.endswith("/")


def users_and_roles_apply(user: str, roles: Iterable[str]) -> Column:
    """User list and role must both let the user in; an empty one lets anybody in."""
    users = scalars.users_list(F.col("users"))
    role = F.lower(F.coalesce(F.col("role_name"), F.lit("")))
    names = ["", *[r.lower() for r in roles]]
    return ((F.size(users) == 0) | F.array_contains(users, user)) & role.isin(*names)


def applicable_rules(
    rules: DataFrame, user: str, roles: Iterable[str] = (), level: str = "R"
) -> DataFrame:
    """The rules that count for this user when `level` is asked for."""
    return rules.where(
        users_and_roles_apply(user, roles) & levels.grants(F.col("access_level"), level)
    )


def _folded(rules: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """One row per drive with, for each level, its include and exclude patterns."""
    text = F.col("rule_text")
    joinable = ~text.rlike(NOT_JOINABLE)
    grouped = F.concat(F.lit("(?:"), text, F.lit(")"))
    columns = []
    for level in wanted:
        counts = levels.grants(F.col("access_level"), level)
        for side, on_side in (("in", ~F.col("exclude")), ("ex", F.col("exclude"))):
            keep = counts & on_side
            # one alternation for the plain patterns, so that one regex per drive is compiled
            plain = F.collect_list(F.when(keep & joinable, grouped))
            columns += [
                F.when(F.size(plain) > 0, _full(F.array_join(plain, "|"))).alias(f"_{side}_re_{level}"),
                F.collect_list(F.when(keep & ~joinable, _full(text))).alias(f"_{side}_odd_{level}"),
            ]
        columns.append(
            F.collect_list(F.when(counts & ~F.col("exclude"), text)).alias(f"_in_text_{level}")
        )
    return rules.groupBy("drive_id").agg(*columns)


def _hit(path: Column, side: str, level: str) -> Column:
    """Whether the include or exclude patterns of a level match."""
    plain = F.col(f"_{side}_re_{level}")
    # regexp_instr keeps the last compiled pattern, rlike would compile per row
    matched = F.coalesce(F.call_function("regexp_instr", path, plain) > 0, F.lit(False))
    odd = F.exists(F.col(f"_{side}_odd_{level}"), lambda p: F.rlike(path, p))
    return matched | F.coalesce(odd, F.lit(False))


def _folded_test(path: Column, level: str) -> Column:
    """The include and exclude test for one level over the patterns of the drive."""
    allowed = _hit(path, "in", level)
    if level == "R":
        above = F.exists(
            F.col(f"_in_text_{level}"), lambda text: F.coalesce(text.startswith(path), F.lit(False))
        )
        allowed = allowed | (F.coalesce(above, F.lit(False)) & path.endswith("/"))
    return allowed & ~_hit(path, "ex", level)


# The leading characters of a pattern that stand for themselves, up to a slash no quantifier follows.
LITERAL_FOLDER = r"^([^\\.\[\](){}*+?|^$]*/)(?![*+?{])"


def literal_folder(rule_text: Column) -> Column:
    """The folder every path that matches the rule lies in; empty when the text does not tell."""
    told = F.regexp_extract(rule_text, LITERAL_FOLDER, 1)
    return F.when(rule_text.contains("|"), F.lit("")).otherwise(told)


# Texts of which no word is told: alternatives, inline options, quotes, repeated groups, odd character classes.
NOT_TOLD = r"\||\(\?|\\[QEx0ucp]|\)[*+?{]|&&|\[\^?\]|\[[^\]]*\["
# What a pattern's text is read as, in this order: a character that ends words but is told, or anything at all.
_READ = (
    (r"[()]", ""),
    (r"\\([^A-Za-z0-9])|\[([^A-Za-z0-9\\^])\]", "\u0001"),
    (r"\\[A-Za-z0-9]|\[[^\]]*\]", "\u0000"),
    (r"(?s).(?:[*+?]|\{[0-9,]*\})[+?]?", "\u0000"),
    (r"\A\^|\$\z", ""),
    (r"[.^$]", "\u0000"),
)
_WORD = r"(?<![A-Za-z0-9\u0000])[A-Za-z0-9]+(?![A-Za-z0-9\u0000])"
#: Tasks that share the paths and rules of one piece.
SALTS = 16


def required_piece(rule_text: Column) -> Column:
    """A piece that every path has which the rule matches: a folder it lies in (ending in a slash) or a whole
    word of letters and digits, whichever is longer; empty when the text tells neither."""
    read = rule_text
    for pattern, instead in _READ:
        read = F.regexp_replace(read, F.lit(pattern), F.lit(instead))
    words = F.regexp_extract_all(read, F.lit(_WORD), F.lit(0))
    word = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    folder = literal_folder(rule_text)
    told = F.when(F.length(word) > F.length(folder), word).otherwise(folder)
    return F.when(rule_text.rlike(NOT_TOLD), folder).otherwise(told)


def path_pieces(path: Column) -> Column:
    """The pieces a rule may require of a path: its folders, its words, and the empty one."""
    words = F.split(path, "[^A-Za-z0-9]+", -1)
    return F.array_distinct(F.concat(F.array(F.lit("")), paths.beginnings(path), words))


def _candidates(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Each path with the columns of the rules that match it, looked up by the piece they require.

    Paths are dealt into SALTS by their hash and rules go to all of them, so a piece that most paths
    have is shared by several tasks.
    """
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    keyed = items.select("drive_id", "path").distinct().select(
        "drive_id", "path", salt.alias("_salt"), F.explode(path_pieces(F.col("path"))).alias("_piece")
    )
    index = rules.select(
        "*", required_piece(F.col("rule_text")).alias("_piece"), _full(F.col("rule_text")).alias("_pattern"),
        F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"),
    )
    matched = F.call_function("regexp_instr", F.col("path"), F.col("_pattern")) > 0
    return keyed.join(index, ["drive_id", "_piece", "_salt"]).where(matched)


def _verdicts(items: DataFrame, rules: DataFrame, wanted: list[str]) -> DataFrame:
    """(drive_id, path) that some rule speaks of, with `_in_<level>` and `_ex_<level>`."""
    sides = {"in": ~F.col("exclude"), "ex": F.col("exclude")}
    flags = {
        f"_{side}_{level}": levels.grants(F.col("access_level"), level) & on
        for level in wanted for side, on in sides.items()
    }
    told = _candidates(items, rules).select("drive_id", "path", *[f.alias(n) for n, f in flags.items()])
    if "R" in wanted:
        readable = rules.where(~F.col("exclude") & levels.grants(F.col("access_level"), "R"))
        above = readable.select("drive_id", F.explode(paths.beginnings(F.col("rule_text"))).alias("path"))
        told = told.unionByName(
            above.where("path <> ''").distinct().select("drive_id", "path", *[F.lit(n == "_in_R").alias(n) for n in flags])
        )
    return told.groupBy("drive_id", "path").agg(*[F.bool_or(n).alias(n) for n in flags])


def _verdict_test(path: Column, level: str) -> Column:
    return F.col(f"_in_{level}") & ~F.col(f"_ex_{level}")


def _compiling(rules: DataFrame) -> DataFrame:
    """The rules, failing on a pattern that does not compile by itself.

    Wrapped for the full match, a text such as ``a)(b`` would become a pattern
    that grants something its author never wrote.
    """
    return rules.where(F.rlike(F.lit(""), F.col("rule_text")).isNotNull())


def _fits_folding(folded: DataFrame) -> bool:
    return fits_broadcast(folded, max_bytes=FOLDED_BYTES)


def with_held(
    items: DataFrame, rules: DataFrame, user: str, roles: Iterable[str], wanted: list[str]
) -> DataFrame:
    """Items with a boolean `_held_<level>` for each wanted level."""
    mine = _compiling(rules.where(users_and_roles_apply(user, roles)))
    folded = _folded(mine, wanted)
    if _fits_folding(folded):
        joined, test = items.join(F.broadcast(folded), "drive_id", "left"), _folded_test
    else:
        joined, test = items.join(_verdicts(items, mine, wanted), ["drive_id", "path"], "left"), _verdict_test
    tests = [
        F.coalesce(test(F.col("path"), level), F.lit(False)).alias(f"_held_{level}")
        for level in wanted
    ]
    return joined.select(*[F.col(c) for c in items.columns], *tests)


def matching_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(drive_id, path, rule_ids): the rules, in order of id, whose text each item matches.

    Items that no rule matches have no row.
    """
    found = _candidates(items, _compiling(rules)).groupBy("drive_id", "path").agg(
        F.sort_array(F.collect_list("rule_id")).alias("rule_ids")
    )
    return items.select("drive_id", "path").join(found, ["drive_id", "path"])


def folders_above_rules(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(drive_id, path, rule_id) for every folder that a rule's text begins with."""
    above = rules.select(
        "drive_id", "rule_id", F.explode(paths.beginnings(F.col("rule_text"))).alias("path")
    ).where("path <> ''")
    return folders.select("drive_id", "path").join(above, ["drive_id", "path"])


def access_filter(
    items: DataFrame, rules: DataFrame, user: str, roles: Iterable[str] = (), level: str = "R"
) -> DataFrame:
    """The items on which the user holds `level`."""
    flag = f"_held_{level}"
    return with_held(items, rules, user, roles, [level]).where(F.col(flag)).drop(flag)


HELD = ["D", "M", "C", "R", "A", "U"]


def _level_names() -> Column:
    """Names of the levels in the `_held_` columns: the highest of Delete, Modify, Create and Read
    brings the lower ones along; Archive and Restore stand alone."""
    held = {level: F.col(f"_held_{level}") for level in HELD}

    def names(codes: str) -> Column:
        return F.array(*[F.lit(levels.LEVEL_NAMES[c]) for c in codes])

    ladder = (
        F.when(held["D"], names("RCMD"))
        .when(held["M"], names("RCM"))
        .when(held["C"], names("RC"))
        .when(held["R"], names("R"))
        .otherwise(F.array().cast("array<string>"))
    )
    alone = [
        F.when(held[c], names(c)).otherwise(F.array().cast("array<string>")) for c in "AU"
    ]
    return F.concat(ladder, *alone)


def with_access_levels(
    items: DataFrame, rules: DataFrame, user: str, roles: Iterable[str] = ()
) -> DataFrame:
    """Items with the names of all levels held.

    The highest of Delete, Modify, Create and Read brings the lower ones along;
    Archive and Restore stand alone.
    """
    flagged = with_held(items, rules, user, roles, HELD)
    return flagged.select(*[F.col(c) for c in items.columns], _level_names().alias("access_levels"))


def catalog_query(
    items: DataFrame, rules: DataFrame, user: str, roles: Iterable[str] = (), **wanted: object
) -> DataFrame:
    """What a user sees of the catalog: the items `query_items` finds (start, recursive, pattern, ...)
    that the user may read, with the names of all levels held on them.

    The query's tests reach the scan, so rules meet the found items only, and one join answers both
    whether an item may be read and what else may be done with it. An input column named
    `access_levels` is replaced.
    """
    kept = [c for c in items.columns if c != "access_levels"]
    flagged = with_held(query_items(items, **wanted).select(*kept), rules, user, roles, HELD)
    return flagged.where(F.col("_held_R")).select(*kept, _level_names().alias("access_levels"))
