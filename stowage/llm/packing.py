"""Packing token sequences: large-item matching, then best fit.

Lengths are whole numbers up to the capacity, so how many pieces there are of each length says all
about them. The bins are worked out on those counts (at most `capacity` numbers, whatever
the corpus): pieces above a third of the capacity are matched greedily, at most two a
bin, and the smaller ones go by falling length into the tightest gap. The outcome is a list of runs:
pieces of one length, by rank, to consecutive bins. Spark ranks the pieces of each length
and looks their runs up.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowage.llm.ranges import running_sum
from stowage.session import materialize

PART_ROWS = 50_000


#: Fixed value: how byte-level tokenizers of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_sign() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenIds:
    """Ids of a byte-level BPE tokenizer file as little-endian bytes.

    The file's vocabulary is handed to tiktoken, which merges several times faster than the
    file's own library and gives the same ids. A special token's string in a text counts as the token.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers that leave the text as it is are supported")
        byte, specials = byte_of_sign(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte[c] for c in word): number
            for word, number in model["vocab"].items() if word not in specials
        }
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary are not in the order of the merges")
        self.model = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=specials)

    def encode(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row per piece of each text's ids plus the end id; only the first piece may be shorter than
    the capacity when there are several. A null text is empty and has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = TokenIds(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for number, text in zip(*(batch.column(c).to_pylist() for c in range(2))):
                data = ids.encode(text) + end
                total = len(data) // 4
                begin, stop, piece = 0, (total - 1) % capacity + 1, 0
                while begin < total:
                    crc = zlib.crc32(data[4 * begin : 4 * stop])
                    rows.append((number, piece, begin, stop - begin, crc))
                    begin, stop, piece = stop, stop + capacity, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES
                )

    return docs.select(
        F.col(id_column).cast("bigint"), F.coalesce(F.col(text_column), F.lit(""))
    ).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Bins:
    """Equal bins: how many, what is still free in each, and pieces as (length, number in each bin)."""

    count: int
    gap: int
    items: list[tuple[int, int]]

    def take(self, count: int, length: int, each: int) -> Bins:
        """Split off `count` bins and put `each` pieces into every one."""
        self.count -= count
        return Bins(count, self.gap - length * each, [*self.items, (length, each)])


def pack_counts(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Bins for so many pieces of each length."""
    left = dict(counts)
    by_gap: dict[int, list[Bins]] = defaultdict(list)

    def put(bins: Bins) -> None:
        if bins.count:
            by_gap[bins.gap].append(bins)

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for other in (n for n in large if n <= min(length, capacity - length)):
            pairs = left[length] // 2 if other == length else min(left[length], left[other])
            left[length] -= pairs
            left[other] -= pairs
            items = [(length, 2)] if other == length else [(length, 1), (other, 1)]
            put(Bins(pairs, capacity - length - other, items))
        put(Bins(left[length], capacity - length, [(length, 1)]))
        left[length] = 0
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[length]
        for gap in sorted(g for g in by_gap if g >= length):
            each = gap // length
            for bins in by_gap[gap]:
                whole = min(bins.count, rest // each)
                put(bins.take(whole, length, each))
                rest -= whole * each
                if rest and bins.count:
                    put(bins.take(1, length, rest))
                    rest = 0
            by_gap[gap] = [b for b in by_gap[gap] if b.count]
            if not rest:
                break
        fresh, each = Bins(-(-rest // (capacity // length)), capacity, []), capacity // length
        put(fresh.take(rest // each, length, each))
        if rest % each:
            put(fresh.take(1, length, rest % each))
    return [bins for gap in sorted(by_gap) for bins in by_gap[gap]]


def runs_of(bins: list[Bins], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number in each bin, first bin, offset), by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for some in bins:
        offset = 0
        for length, each in some.items:
            rows.append((length, rank[length], each, first, offset))
            rank[length] += each * some.count
            offset += each * length
        first += some.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The stored pieces with sequence_id and offset. Pieces of one length are ranked by a hash of
    their id and number; equal rows take consecutive ranks and are packed as often as they occur."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = runs_of(pack_counts(counts, capacity), capacity)
    parts = 1 + sum(counts.values()) // PART_ROWS
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = running_sum(
        pieces.withColumn("_place", place).withColumn("_part", F.pmod("_place", F.lit(parts)).cast("int")),
        "length", "_part", ["_place", "doc_id", "piece", "ids_crc32"], F.lit(1), "_rank",
    )
    # Rows of `runs` in order of length and rank have rising keys; a key fits 64 bits.
    keys = runs[:, 0] << 50 | runs[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        wanted = length.to_numpy(np.int64) << 50 | rank.to_numpy(np.int64)
        run = runs[np.searchsorted(keys, wanted, side="right") - 1]
        since = rank.to_numpy(np.int64) - run[:, 1]
        return pd.DataFrame({
            "sequence_id": run[:, 3] + since // run[:, 2],
            "offset": run[:, 4] + since % run[:, 2] * run[:, 0],
        })

    return ranked.withColumn("_at", look_up("length", "_rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece, repeated rows packed each."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
