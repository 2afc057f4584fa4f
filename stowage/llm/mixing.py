"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hash order, up to three times round. A document's virtual
finish time is what its source has sent by its end over the source's target, so a mix in order of finish time
serves every source in proportion to its target, and its budget, the sum of the targets, lasts to the time 1. What
ends by then is taken. Of the documents that run across it, one a source, those that leave their source nearer its
target are taken in order of finish time while the budget is not used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.llm.ranges import running_sum
from stowage.operators.scale import running_total
from stowage.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
PASSES = 3
#: Rows of one part of a source while its sizes are added up.
PART_ROWS = 50_000
#: Rows made at once of equal rows that were counted.
REPEATED = 10_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def place_of(id_column: str, text_column: str, seed: int) -> Column:
    """Where a document stands in its source's queue: a hash of its id and text."""
    return F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))


def part_of(place: Column, parts: int) -> Column:
    """Part 0 to parts - 1 by the upper bits of the hash."""
    return F.shiftright(F.shiftrightunsigned(place, 33) * parts, 31)


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with `number`, 0 for the first by code point, null last; sorted by ranges, not in one task."""
    ordered = materialize(
        sources.orderBy(F.asc_nulls_last("source")).withColumn("_m", F.monotonically_increasing_id()),
        "sources",
    ).withColumn("_part", F.shiftright("_m", 33))
    counts = sorted(map(tuple, ordered.groupBy("_part").count().collect()))  # one row per partition
    before, total = [], 0
    for part, count in counts:
        before += [F.lit(part), F.lit(total)]
        total += count
    offset = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    return ordered.withColumn(
        "number", (offset + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("bigint")
    ).drop("_m", "_part")


def source_targets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """Per source its number, size and target; and all words together.

    A target is the weight's share of all words, at most PASSES times the source's size; what
    is cut off is shared out again by weight among the sources below that, until none is above.
    Each round is one sum over the table of sources.
    """
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS)).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "sources")
    budget, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, weights, fixed, capped = budget or 0, weights or 0, 0, -1
    level = 0.0
    while weights:
        level = (budget - fixed) / weights
        above = F.col("weight") * level >= PASSES * F.col("source_size")
        now, fixed, weights = sources.agg(
            F.count_if(above), F.sum(F.when(above, PASSES * F.col("source_size")).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
        ).first()
        if now == capped:
            break
        capped = now
    target = F.least(
        (PASSES * F.col("source_size")).cast("double"), F.col("weight") * F.lit(float(level))
    )
    return sources.withColumn("target", target), budget


def crossing_documents(sent: DataFrame, budget: int) -> DataFrame:
    """A row per source with the document that runs across its target: where it stands, how many of its
    equals are taken, how many there are, and the whole rounds before.

    `sent` has a row per source and place: number, source_size, target, size, rows (equal ones) and the
    words `before`. Equal documents follow each other in the queue.
    """
    rounds = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(PASSES)).cast("int")
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    across = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("rows") * F.col("size"))
    whole = F.floor((F.col("rest") - F.col("before")) / F.col("size"))
    ends = sent.withColumn("rounds", rounds).withColumn("rest", rest).where(across & (F.col("rounds") < PASSES))
    ends = ends.withColumn("whole", whole).withColumn(
        "missing", F.col("rest") - F.col("before") - F.col("whole") * F.col("size")
    )
    finish = (F.col("target") - F.col("missing") + F.col("size")) / F.col("target")
    ends = materialize(ends.withColumn("finish", finish).withColumn("one", F.lit(0)), "ends")
    left = ends.agg(F.sum("missing")).first()[0] or 0.0  # all that ends by the time 1 is within the budget
    nearer = ends.where(F.col("size") - F.col("missing") < F.col("missing"))
    queue = running_total(nearer, ["one"], ["finish", "number"], F.col("size"), "upto")
    taken = queue.where(F.col("upto") - F.col("size") < left).select("number", F.lit(1).alias("more"))
    return ends.join(taken, "number", "left").select(
        "number", "part", "place", "rows",
        (F.col("whole") + F.coalesce("more", F.lit(0))).cast("bigint").alias("ahead"),
    )


def mix_plan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", seed: int = 11,
) -> tuple[DataFrame, DataFrame, int]:
    """Measured documents (equal ones as one row with their number), a row per source that says how far its
    queue is taken, and the parts.

    A source's row has its size, target, whole `rounds` and the (part, place) up to which one more
    round goes, with how many of the rows at that place; part -1 takes no more. Its size is that of a table of
    sources, not of documents.
    """
    measured = materialize(
        docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"),
            size_of(F.col(text_column)).alias("size"),
            place_of(id_column, text_column, seed).alias("place"),
        ).groupBy("id", "source", "size", "place").agg(F.count(F.lit(1)).alias("rows")),
        "sizes",
    )
    parts = 1 + measured.count() // PART_ROWS
    sources, budget = source_targets(measured.withColumn("size", F.col("size") * F.col("rows")))
    sources = materialize(sources, "targets")
    placed = measured.join(
        sources.select("source", "number", "source_size", "target"),
        measured["source"].eqNullSafe(sources["source"]),
    ).where("target > 0 AND size > 0").groupBy("number", "source_size", "target", "place").agg(
        F.max("size").alias("size"), F.sum("rows").alias("rows")
    )
    sent = running_sum(
        placed.withColumn("part", part_of(F.col("place"), parts)), "number", "part", ["place"],
        F.col("size") * F.col("rows"), "before",
    )
    ends = crossing_documents(materialize(sent, "queue"), budget)
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(PASSES)))
    plan = sources.join(ends, "number", "left").select(
        "number", "source", "source_size", "target",
        F.coalesce(rounds, F.lit(0)).cast("int").alias("rounds"),
        F.coalesce("part", F.lit(-1)).alias("end_part"),
        F.coalesce("place", F.lit(0)).alias("end_place"),
        F.coalesce("ahead", F.lit(0)).alias("end_ahead"),
        F.coalesce("rows", F.lit(0)).alias("end_rows"),
    )
    return measured, materialize(plan, "mix"), parts


def at_end(place: Column, parts: int) -> Column:
    return (part_of(place, parts) == F.col("end_part")) & (place == F.col("end_place"))


def copies_of(place: Column, parts: int, number: Column) -> Column:
    """How often the mix takes a document of its source's plan row; `number` counts its equals from 0."""
    part = part_of(place, parts)
    before = (part < F.col("end_part")) | ((part == F.col("end_part")) & (place < F.col("end_place")))
    one_more = before | (at_end(place, parts) & (number < F.col("end_ahead")))
    return F.col("rounds") + F.when(one_more, 1).otherwise(0)


def mix_sources(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row.

    Null texts have no words; documents without words are taken zero words. A null source is a source of
    its own, the last one. Rows equal in id and text follow each other in the queue, and the cut may fall between them.
    """
    measured, plan, parts = mix_plan(docs, seed=seed)
    some = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / REPEATED)))
    runs = measured.join(plan, measured["source"].eqNullSafe(plan["source"])).withColumn("_run", some)
    each = F.sequence(F.col("_run") * REPEATED, F.least(F.col("rows"), (F.col("_run") + 1) * REPEATED) - 1)
    return runs.withColumn("_number", F.explode(each)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * copies_of(F.col("place"), parts, F.col("_number"))).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents as the mix takes them: repeated up to PASSES times, or left out.

    Only the plan row of its source is joined to a document, so texts are not shuffled
    unless there are too many sources to send to every task. Documents without words
    are kept once: they use none of the budget. Which of the rows equal in id, text and source goes a round
    more where the cut falls between them is not said.
    """
    _, plan, parts = mix_plan(docs, seed=seed)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("source").alias("_source"),
        (size_of(F.col("text")) == 0).alias("_empty"),
        place_of("doc_id", "text", seed).alias("_place"),
    ).join(plan, F.col("_source").eqNullSafe(F.col("source")))
    cut = at_end(F.col("_place"), parts) & (F.col("end_rows") > 1) & ~F.col("_empty")
    equal = materialize(rows.where(cut).withColumn("_slot", F.spark_partition_id()), "equal")
    equal = running_sum(equal, "number", "_slot", [F.xxhash64("_doc")], F.lit(1), "_number").drop("_slot")
    rows = rows.where(~cut).withColumn("_number", F.lit(0).cast("bigint")).unionByName(equal)
    copies = F.when(F.col("_empty"), 1).otherwise(copies_of(F.col("_place"), parts, F.col("_number")))
    return (
        rows.withColumn("_copies", copies)
        .where("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_doc.*")
    )
