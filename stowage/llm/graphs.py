"""Connected components as joins and aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.session import materialize


def roots_of(parents: DataFrame) -> DataFrame:
    """(node, parent) forest with parents below their nodes, to (node, root), by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        jumped = materialize(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("_above", "parent").alias("parent"),
                F.col("_above").isNotNull().alias("_moved"),
            ),
            "roots",
        )
        parents = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): the smallest node it can reach.

    Each round links every node to its smallest neighbour below it, follows the links to their
    roots and replaces the ends of the edges by those; what remains are edges between roots.
    Tables are written between the steps, so nothing is gathered and a lost executor costs a re-read.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    active = materialize(ordered.distinct(), "edges")
    labels = None
    while not active.isEmpty():
        links = active.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        roots = roots_of(links)
        to_a = roots.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        to_b = roots.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        # Every a has a root; a b has one only if it stands above some other node.
        ends = active.join(to_a, "a").join(to_b, "b", "left").select(
            "_a", F.coalesce("_b", "b").alias("_b")
        )
        found = roots.select("node", F.col("parent").alias("label"))
        if labels is not None:
            moved = roots.select(F.col("node").alias("label"), F.col("parent").alias("_to"))
            found = found.unionByName(
                labels.join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
            )
        labels = materialize(found, "labels")
        active = materialize(
            ends.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
            .where("a <> b").distinct(),
            "edges",
        )
    if labels is None:
        return active.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # A root is below every node it was linked to, and stands for itself.
    own = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(own)


def lookup(rows: DataFrame, names: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """The rows left-joined to the stored `names` on keys of which some have a large share of the rows.

    Keys with more than a ten-thousandth of the rows (and 1,000) are at most 10,000; their names go to every
    task. The others are joined by a shuffle in which no key is large.
    """
    total = names.agg(F.sum(copies)).first()[0] or 0
    many = F.col(copies) > max(1000, total // 10_000)
    crowded = names.where(many).drop(copies).withColumn("_named", F.lit(True))
    first = rows.join(F.broadcast(crowded), keys, "left")
    found = first.where("_named").drop("_named")
    rest = first.where("_named IS NULL").select(rows.columns).join(names.where(~many).drop(copies), keys, "left")
    return found.unionByName(rest.select(found.columns))
