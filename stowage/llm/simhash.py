"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within two bits of each other agree in at least two of four 16-bit parts, so each is filed
under six keys of 32 bits. A key with more than `CROWDED` fingerprints is filed again by
pairs of the four bytes of its other 32 bits: again two of them agree. A group then shares 48 bits,
which leaves at most 65,536 different fingerprints. Groups are compared in blocks: bit j of all
members stands in plane j, a shifted plane xor itself gives the differences of all pairs at
that distance in the group, and carry-save counters add them up 64 pairs a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stowage.llm.graphs import components, lookup
from stowage.session import materialize

SEED = 42
RADIUS = 2
CROWDED = 4096
#: Fingerprints compared in one set of planes, unless a group is larger.
AT_ONCE = 1 << 17


def text_fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the XXH64 of all word shingles, repeats included; 0 without words."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes: lower-cases and splits ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        begins = np.r_[0, spaces + 1].tolist()
        ends = np.r_[spaces, len(joined)].tolist()
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[b:e], SEED) for b, e in zip(begins, ends[words - 1 :])]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(values), 1 << 16):
        some = values[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash_fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *carried: Column
) -> DataFrame:
    """Id and `fp` (the 64 bits as a signed number) of each row; null texts count as empty."""

    @F.pandas_udf("bigint")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([text_fingerprint(t) for t in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.select(
        F.col(id_column), fingerprint(F.coalesce(F.col(text_column), F.lit(""))).alias("fp"), *carried
    )


def filed(fingerprints: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints: equal keys for all that can be within RADIUS."""

    def part(value, place: int, width: int):
        return F.shiftrightunsigned(value, place * width).bitwiseAND((1 << width) - 1)

    fp = F.col("fp")
    # A key holds which parts it was made of, then the parts; the other parts fill `rest`.
    options = []
    for number, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (p for p in range(4) if p not in (i, j))
        key = F.shiftleft(part(fp, i, 16), 16).bitwiseOR(part(fp, j, 16))
        rest = F.shiftleft(part(fp, k, 16), 16).bitwiseOR(part(fp, m, 16))
        options.append(F.struct((key + (number << 32)).alias("key"), rest.alias("rest")))
    first = fingerprints.select("fp", F.explode(F.array(*options)).alias("o")).select("fp", "o.*")
    crowded = (
        first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
        .select("key", F.lit(True).alias("crowded"))
    )
    finer = [
        F.shiftleft(F.col("key"), 20)
        + (number << 16)
        + F.shiftleft(part(F.col("rest"), i, 8), 8).bitwiseOR(part(F.col("rest"), j, 8))
        for number, (i, j) in enumerate(combinations(range(4), 2), 1)
    ]
    keys = F.when(F.col("crowded"), F.array(*finer)).otherwise(F.array(F.shiftleft(F.col("key"), 20)))
    return first.join(crowded, "key", "left").select(F.explode(keys).alias("key"), "fp")


def shifted(plane: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """The given words of a plane moved down by `by` bits; planes end in enough zero words."""
    whole, part = divmod(by, 64)
    low = plane[words + whole]
    if not part:
        return low
    return (low >> np.uint64(part)) | (plane[words + whole + 1] << np.uint64(64 - part))


def packed(bits: np.ndarray, words: int) -> np.ndarray:
    held = np.packbits(bits, bitorder="little")
    return np.r_[held, np.zeros(8 * words - len(held), np.uint8)].view("<u8")


def close_pairs(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> Iterator[np.ndarray]:
    """Index pairs (2, n) within `radius` bits and one key; the rows are sorted by key."""
    n = len(keys)
    if not n:
        return
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    largest = int(np.diff(np.r_[begins, n]).max())
    words = -(-n // 64)
    spare = words + largest // 64 + 2
    one = np.uint64(1)
    planes = [packed((values >> np.uint64(j)) & one != 0, spare) for j in range(64)]
    for by in range(1, largest):
        same = packed(keys[:-by] == keys[by:], words)
        open_words = np.flatnonzero(same)
        if not len(open_words):
            continue
        over = ~same[open_words]
        # ones, twos, fours: bits of the count; past the radius a pair stays `over`.
        counters = [np.zeros(len(open_words), np.uint64) for _ in range(radius.bit_length())]
        for j in range(64):
            carry = planes[j][open_words] ^ shifted(planes[j], open_words, by)
            for b, counter in enumerate(counters):
                carry, counters[b] = counter & carry, counter ^ carry
            over |= carry | exceeded(counters, radius)
            if j % 8 == 7:  # abandon the blocks in which every pair is past the radius
                kept = np.flatnonzero(~over)
                if not len(kept):
                    break
                if len(kept) < len(over):
                    open_words, over = open_words[kept], over[kept]
                    counters = [c[kept] for c in counters]
        else:
            left = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(left)
            at = open_words[row] * 64 + bit
            if len(at):
                yield np.stack([at, at + by])


def exceeded(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counted number is above `radius`, word by word."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for b in range(len(counters) - 1, -1, -1):
        if radius >> b & 1:
            equal &= counters[b]
        else:
            above |= equal & counters[b]
            equal &= ~counters[b]
    return above


def star_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each member of a cluster to the cluster's first member, by key."""
    root = np.arange(len(keys))
    for a, b in close_pairs(keys, values):
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(root, high[apart], low[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    member = np.flatnonzero(root != np.arange(len(root)))
    return values[member], values[root[member]]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key; whole groups are compared, about AT_ONCE rows at a time."""
    keys = np.zeros(0, np.int64)
    values = np.zeros(0, np.uint64)

    def compared(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        same = keys[1:] == keys[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        a, b = star_links(keys[several], values[several])
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINKS
        )

    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        values = np.r_[values, batch.column(1).to_numpy().view(np.uint64)]
        if len(keys) >= AT_ONCE and keys[0] != keys[-1]:
            whole = int(np.searchsorted(keys, keys[-1]))
            yield compared(keys[:whole], values[:whole])
            keys, values = keys[whole:], values[whole:]
    if len(keys):
        yield compared(keys, values)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *carried: Column
) -> DataFrame:
    """Each row with its fingerprint (16 hexadecimal digits) and the smallest id of its component.

    Components join fingerprints at most RADIUS bits apart, over any number of steps. Copies are one
    fingerprint and never compared. Rows without words share fingerprint 0; null ids get a
    component but never name one, so a component of null ids only is null. `carried` columns go along.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_docs = materialize(simhash_fingerprints(docs, id_column, text_column, *carried), "simhash")
    classes = materialize(
        of_docs.groupBy("fp").agg(F.min(id_column).alias("first"), F.count(F.lit(1)).alias("copies")), "simhash"
    )
    keyed = filed(classes.select("fp")).repartition(parts, "key").sortWithinPartitions("key", "fp")
    labels = components(keyed.mapInArrow(_links, "a bigint, b bigint"))
    linked = labels.select(F.col("node").alias("fp"), "label").join(classes, "fp")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = linked.join(smallest, "label").select("fp", "component_id")
    named = classes.join(of_class, "fp", "left").select(
        "fp", "copies", F.coalesce("component_id", "first").alias("component_id")
    )
    return lookup(of_docs, materialize(named, "simhash"), ["fp"], "copies").select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *of_docs.columns[2:],
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with the input's columns.

    Of rows equal in id and text one stays. Rows of a null id stay, once per text.
    """
    text_hash = F.xxhash64(text_column)
    found = near_duplicates(docs, id_column, text_column, text_hash.alias("_gone_hash"))
    gone = found.where(F.col(id_column) != F.col("component_id")).select(
        F.col(id_column).alias("_gone_id"), "_gone_hash"
    ).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(id_column).alias("_id"), text_hash.alias("_hash"),
    )
    # An id may have several texts; only those of its rows that a smaller id stands for go.
    same = (F.col("_id") == F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash"))
    kept = rows.join(gone, same, "left_anti")
    return kept.dropDuplicates(["_id", "_hash"]).select("_doc.*")
