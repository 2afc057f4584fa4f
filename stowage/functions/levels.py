"""Access levels of the rules: codes, names and which level grants which."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One letter per access level, and its name.
LEVEL_NAMES = {
    "N": "None",
    "R": "Read",
    "C": "Create",
    "M": "Modify",
    "D": "Delete",
    "U": "Restore",
    "A": "Archive",
}

# The levels each held level grants.
GRANTS = {
    "N": "N",
    "R": "R",
    "C": "CR",
    "M": "MCR",
    "D": "DMCR",
    "U": "U",
    "A": "A",
}


def access_code(letter: Column) -> Column:
    """Upper-case level letter; anything unknown, null included, is ``N``."""
    upper = F.upper(letter)
    return F.when(upper.isin(*LEVEL_NAMES), upper).otherwise(F.lit("N"))


def access_name(letter: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in LEVEL_NAMES.items() for v in pair])
    return F.element_at(names, access_code(letter))


def grants(held: Column, asserted: str) -> Column:
    """Whether a rule of level `held` counts when level `asserted` is asked for."""
    givers = [code for code, given in GRANTS.items() if asserted in given]
    return access_code(held).isin(*givers)
