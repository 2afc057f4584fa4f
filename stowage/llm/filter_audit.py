"""Which filter removes what, in every order, as a stream that takes back what it said too early.

All files of a table are read as micro-batches. Whether a text is a copy of a smaller id's depends on files that have
not come yet, so a state per text keeps the smallest id so far and who holds it. A document is counted with the
filters it fails as soon as it arrives; when a smaller id with the same text comes, the earlier holders are taken out
of the counters and put back as copies. What is kept at the end are counts per part and set of failed filters, and those
give every order of the filters.

The state is keyed by text digests, TEXTS_PER_KEY of them to a state row, since a row of its own for each text costs
milliseconds. Batches are combined before they are shuffled, so a text that a third of all rows
repeat is a row per task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from stowage.session import shared_folder

LETTERS = "ABCDE"
FILTERS = len(LETTERS)
COPY = 1 << LETTERS.index("E")
GOOD, TOXIC = 1 << FILTERS, 1 << (FILTERS + 1)
#: What the filters measure.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SIGNS = 100, 80, 10, b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
#: Bytes that go on with a code point; those left begin one.
FOLLOWING = bytes(range(0x80, 0xC0))
TEXTS_PER_KEY = 256
#: Combined rows a task holds before it sends them on.
HELD = 200_000


def failed_filters(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = text.split()  # bytes: splits at ASCII space only
    points = len(text.translate(None, FOLLOWING))
    upper = len(text) - len(text.translate(None, UPPER))
    fails = len(words) < LEAST_WORDS
    fails |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    fails |= (100 * upper > MOST_UPPER * points) << 2
    return int(fails | any(s in text for s in SIGNS) << 3)


MEASURED = pa.schema([
    ("key", pa.int64()), ("digest", pa.binary()), ("part", pa.string()), ("id", pa.int64()), ("flags", pa.int32()),
])
MEASURED_DDL = "key bigint, digest binary, part string, id bigint, flags int"


def _measure(keys: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, flags = [], []
            for text in batch.column(2):
                data = text.as_py().encode()
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                flags.append(failed_filters(data))
            key = [int.from_bytes(d[:8], "little") % keys for d in digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(digests, pa.binary()), batch.column(1), batch.column(0),
                 pa.array(flags, pa.int32())], schema=MEASURED,
            )

    return measure


COMBINED = pa.schema([
    ("key", pa.int64()), ("digest", pa.binary()), ("part", pa.string()), ("flags", pa.int32()),
    ("least", pa.int64()), ("holding", pa.int64()), ("rows", pa.int64()),
])
COMBINED_DDL = "key bigint, digest binary, part string, flags int, least bigint, holding bigint, rows bigint"


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one text, part and flags to one: its smallest id, how many rows have that, and how many rows there are."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k[:4], *v) for k, v in held.items()]
        held.clear()
        columns = zip(*rows) if rows else [[]] * len(COMBINED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COMBINED)], schema=COMBINED)

    for batch in batches:
        for key, digest, part, number, flags in zip(*(c.to_pylist() for c in batch.columns)):
            at = held.setdefault((key, digest, part, flags, number is None), [number, 0, 0])
            if number is not None and number < at[0]:
                at[0], at[1] = number, 0
            at[1] += number == at[0]
            at[2] += 1
        if len(held) >= HELD:
            yield out()
    yield out()


def retract(known: dict, rows: list[tuple], changes: Counter) -> None:
    """Take in combined rows (digest, part, flags, least, holding, rows) of one state row.

    `known` maps a digest to (smallest id, {(part, flags): rows that have it}); `changes` gets what the counters
    per (part, flags) gain or lose.
    """
    by_text: dict[bytes, list[tuple]] = {}
    for digest, *row in rows:
        if row[2] is None:  # a null id is no smaller id and has none
            changes[row[0], row[1]] += row[4]
        else:
            by_text.setdefault(digest, []).append(row)
    for digest, some in by_text.items():
        least, holders = known.get(digest, (None, {}))
        smallest = min(row[2] for row in some)
        if least is None or smallest < least:
            for (part, flags), n in holders.items():
                changes[part, flags] -= n
                changes[part, flags | COPY] += n
            least, holders = smallest, {}
        for part, flags, number, holding, n in some:
            first = holding if number == least else 0
            if first:
                holders[part, flags] = holders.get((part, flags), 0) + first
                changes[part, flags] += first
            if n > first:
                changes[part, flags | COPY] += n - first
        known[digest] = least, holders


CHANGES_DDL = "part string, flags int, change bigint"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = pickle.loads(state.get[0]) if state.exists else {}
    changes: Counter = Counter()
    for frame in frames:
        least = [None if pd.isna(x) else int(x) for x in frame["least"]]
        columns = [frame[c].tolist() for c in ("digest", "part", "flags")]
        rows = zip(*columns, least, frame["holding"].tolist(), frame["rows"].tolist())
        retract(known, [(bytes(d), *rest) for d, *rest in rows], changes)
    state.update((pickle.dumps(known),))
    rows = [(part, flags, n) for (part, flags), n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "flags", "change"]).astype({"flags": "int32", "change": "int64"})


def audit_stream(
    docs: DataFrame, labels: DataFrame, path: str, checkpoint: str, keys: int,
    id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", once: bool = True,
) -> StreamingQuery:
    """Keep the changes of the counters below `path`, a folder per micro-batch of the stream `docs`.

    `keys` is the number of state rows; it has to stay the same for a checkpoint. A repeated batch replaces its folder.
    State is kept by the session's state store: Spark's default holds it in the executors' memory, about 100 bytes
    a text; the RocksDB store holds it on disk, at some megabytes for each of the shuffle partitions.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"), text.alias("text"),
    ).mapInArrow(_measure(keys), MEASURED_DDL)
    judged = labels.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0))
         + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("_flags")
    )
    flags = F.col("flags").bitwiseOR(F.coalesce(F.col("_flags"), F.lit(0))).cast("int")
    labelled = rows.join(judged, F.col("id") == F.col("_id"), "left").select(
        "key", "digest", "part", "id", flags.alias("flags")
    )
    changes = labelled.mapInArrow(combined, COMBINED_DDL).groupBy("key").applyInPandasWithState(
        _update, CHANGES_DDL, "texts binary", "append", "NoTimeout"
    )

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "flags").agg(F.sum("change").alias("change"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(part, flags, n): how many documents of a part fail which filters, with which labels."""
    changes = spark.read.schema(f"{CHANGES_DDL}, batch bigint").parquet(path)
    return changes.groupBy("part", "flags").agg(F.sum("change").alias("n")).where("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counters."""
    sets, failed = range(1 << FILTERS), F.col("flags").bitwiseAND((1 << FILTERS) - 1)

    def per_set(label: int) -> Column:
        some = (F.col("flags").bitwiseAND(label) == label) if label else F.lit(True)
        n = [F.coalesce(F.sum(F.when((failed == m) & some, F.col("n"))), F.lit(0)).cast("bigint") for m in sets]
        return F.array(*n)

    parts = counts.groupBy("part").agg(per_set(0).alias("n"), per_set(GOOD).alias("good"), per_set(TOXIC).alias("toxic"))
    steps = [
        ("".join(order), step + 1, 1 << LETTERS.index(letter), sum(1 << LETTERS.index(c) for c in order[:step]))
        for order in permutations(LETTERS) for step, letter in enumerate(order)
    ]
    order, step, own, before = (F.lit(list(c)) for c in zip(*steps))
    rows = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i")).select(
        "part", "n", "good", "toxic", F.get(order, "i").alias("filter_order"), F.get(step, "i").alias("step"),
        F.get(own, "i").alias("own"), F.get(before, "i").alias("before"),
    )

    def total(counted: str, test) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(len(sets) - 1)), F.lit(0).cast("bigint"),
            lambda sum_, m: sum_ + F.when(test(m), F.get(counted, m)).otherwise(0),
        )

    own, before = F.col("own"), F.col("before")

    def here(m: Column) -> Column:
        return (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)

    return rows.select(
        "part", "filter_order", "step", "own",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    ).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit_filters(
    spark: SparkSession, folder: str, labels: DataFrame, batches: int = 4, texts_per_key: int = TEXTS_PER_KEY, **columns: str
) -> DataFrame:
    """The interactions over all parquet files of a folder, read as about `batches` micro-batches.

    Null texts are empty and copies of each other; a null part is the empty string, and so is an empty one. A null id is
    never a copy and makes none. Rows that repeat id and text are no copies of each other. A document with several labels
    rows has a label if one of them says so. Further columns are not read; an empty table has no rows.
    """
    table = spark.read.parquet(folder)
    files = table.inputFiles()
    keys = max(1, table.count() // texts_per_key)
    if len(files) == 1 and files[0].endswith(folder.rsplit("/", 1)[-1]):
        folder = f"{folder[:-1]}[{folder[-1]}]"  # streams read folders and patterns, but no single file
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    stream = stream.parquet(folder)
    place = shared_folder(spark, "audit")
    spark.createDataFrame([], CHANGES_DDL).write.parquet(f"{place}/changes/batch=-1")
    audit_stream(stream, labels, f"{place}/changes", f"{place}/checkpoint", keys, **columns)
    return interactions(counters(spark, f"{place}/changes"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), judged AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN min(words.doc_id) OVER (PARTITION BY t) < words.doc_id THEN 16 ELSE 0 END) AS fails
  FROM words LEFT JOIN judged ON words.doc_id = judged.doc_id
), counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT letter AS o, bit AS used FROM letters
  UNION ALL SELECT o || letter, used + bit FROM orders, letters WHERE used & bit = 0
), steps AS (
  SELECT o, s AS step, bit AS own,
    coalesce((SELECT sum(l.bit) FROM letters l WHERE instr(o, l.letter) < s), 0)::INTEGER AS earlier
  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE length(o) = 5) JOIN letters ON letter = o[s]
), audit AS (
  SELECT part, o AS filter_order, step, own,
    coalesce(sum(n) FILTER (fails & (own | earlier) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & earlier = 0 AND fails & own <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & earlier <> 0 AND fails & own <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & earlier = 0 AND fails & own <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails & earlier = 0 AND fails & own <> 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit
"""
