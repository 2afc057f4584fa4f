"""Phrase collocations by partitioned mining of frequent phrases.

The documents are dealt into SHARDS shards. Each is mined completely, shortest phrases first, at a support
lowered in proportion: a phrase with `support` occurrences altogether has at least
ceil(support / shards) in one of the shards. The union of what is frequent somewhere holds every frequent
phrase; a last pass counts the occurrences of all of those over all shards, by their text.

With a support of 10, ten shards would have a lowered support of 1, which leaves nothing out. So there are few
shards whatever the input, and each is mined by many tasks: phrases are counted per task as 64-bit
hashes in numpy, and only (hash, count) is shuffled. Which phrases a later pass has to look at is
told by a Bloom filter of at most FILTER_BITS; what it lets through by chance is counted and then dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stowage.llm.words import BASE, hashed_words, mixed, salt, separators
from stowage.session import materialize

SHARDS = 3
#: Bytes that end a piece, and bytes between the words of a piece.
ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
UNKNOWN = "und"
#: Bytes of texts looked at together, words of one window, and keys and phrases a task holds.
BLOCK, WINDOW, HELD_KEYS, HELD_PHRASES = 1 << 21, 1 << 19, 3 << 20, 1 << 21
#: Parts of a language whose best phrases are picked first, so that no task ranks those of all tasks.
TOP_PARTS = 16
FILTER_BITS = 1 << 28
PROBES = (np.uint64(BASE), np.uint64(0xD6E8FEB86659FD93))

_BETWEEN = separators(ENDS + BLANKS)
_ENDS = separators(ENDS)


class Span:
    """Consecutive words of a block of texts: hashes of the phrases that begin at each, by number of words."""

    def __init__(self, words, piece: np.ndarray, language: np.ndarray, shard: np.ndarray, low: int, high: int):
        self.low, self.n = low, high - low
        self.shard = shard[low:high]
        value = words.value[low : high + 2]
        piece = piece[low : high + 2]
        phrase = mixed(value[: self.n] + language[low:high])
        # hashes[k] and at[k]: the phrases of k words and the places in the window they begin at.
        self.at, self.hashes = {1: np.arange(self.n)}, {1: phrase}
        for k in (2, 3):
            at = self.at[k - 1]
            at = at[at + k - 1 < len(value)]
            at = at[piece[at + k - 1] == piece[at]]
            before = np.zeros(self.n, np.uint64)
            before[self.at[k - 1]] = self.hashes[k - 1]
            self.at[k] = at
            self.hashes[k] = mixed(before[at] * np.uint64(BASE) + value[at + k - 1] + salt(k))

    def keys(self, k: int) -> np.ndarray:
        """Hashes with the shard in the last two bits."""
        return (self.hashes[k] & ~np.uint64(3)) | self.shard[self.at[k]]


def language_salt(language: str) -> np.uint64:
    return mixed(hashed_words(language.encode(), separators(b"")).value + salt(17))[0] if language else salt(19)


class Block:
    """Some whole texts: their bytes, words and windows."""

    def __init__(self, texts: list[bytes], languages: list[str], shards: list[int]):
        parts = [t.lower() for t in texts]  # bytes: lower-cases A to Z only
        self.data = b"\n".join(parts)
        begins = np.r_[0, np.cumsum([len(p) + 1 for p in parts])[:-1]]
        self.words = hashed_words(self.data, _BETWEEN)
        self.document = np.searchsorted(begins, self.words.begin, "right") - 1
        self.languages = languages
        salts = {x: language_salt(x) for x in set(languages)}
        of = np.array([salts[x] for x in languages], np.uint64)
        ends = np.flatnonzero(_ENDS[np.frombuffer(self.data, np.uint8)])
        self.piece = np.searchsorted(ends, self.words.begin)
        self.salts, self.shards = of[self.document], np.array(shards, np.uint64)[self.document]

    def windows(self) -> Iterator[Span]:
        for low in range(0, len(self.words), WINDOW):
            high = min(low + WINDOW, len(self.words))
            yield Span(self.words, self.piece, self.salts, self.shards, low, high)

    def phrases(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the phrases of k words that begin at the given words, one after the other, and their lengths."""
        words = at[:, None] + np.arange(k)
        begin, length = self.words.begin[words], self.words.end[words] - self.words.begin[words]
        length[:, :-1] += 1  # and the blank after each word but the last
        flat = length.ravel()
        end = np.cumsum(flat)
        places = np.arange(flat.sum()) + np.repeat(begin.ravel() - (end - flat), flat)
        out = np.frombuffer(self.data, np.uint8)[places]
        out[end.reshape(-1, k)[:, :-1] - 1] = 0x20
        return out, length.sum(1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows (text, language, shard) as blocks of about BLOCK bytes; a longer text is a block by itself."""
    texts: list[tuple] = []
    held = 0
    for batch in batches:
        columns = [batch.column(0).cast(pa.binary()), *batch.columns[1:]]
        for row in zip(*(c.to_pylist() for c in columns)):
            texts.append(row)
            held += len(row[0])
            if held >= BLOCK:
                yield Block(*map(list, zip(*texts)))
                texts, held = [], 0
    if texts:
        yield Block(*map(list, zip(*texts)))


class Counts:
    """Keys and how often they came, sorted; raw keys are merged in now and then."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting >= HELD_KEYS // 2:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            key, n = np.unique(np.concatenate(self.raw), return_counts=True)
            both = np.r_[self.key, key]
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.r_[self.n, n][order]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            self.key, self.n = both[first], np.add.reduceat(n, first)
            self.raw, self.waiting = [], 0

    def taken(self) -> pa.RecordBatch:
        self.merge()
        columns = [pa.array(self.key.view(np.int64)), pa.array(self.n)]
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(columns, schema=COUNTED)


COUNTED = pa.schema([("key", pa.int64()), ("n", pa.int64())])
COUNTED_DDL = "key bigint, n bigint"


class Phrases:
    """Occurrences of phrases by their hash; the text of a phrase is read once."""

    def __init__(self) -> None:
        self.languages: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.key, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Of each phrase, in the order they came: occurrences, and in parts language, words, bytes and length.
        self.n, self.parts = np.zeros(0, np.int64), []

    def number(self, language: str) -> int:
        return self.languages.setdefault(language, len(self.languages))

    def add(self, keys: np.ndarray, counts: np.ndarray, read) -> None:
        """Distinct sorted keys; `read` gives (languages, words, bytes, lengths) of the keys at given places."""
        at = np.searchsorted(self.key, keys)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == keys[known]
        self.n[self.place[at[known]]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            places = np.arange(len(new)) + len(self.n)
            self.n = np.r_[self.n, counts[new]]
            self.key, self.place = np.insert(self.key, at[new], keys[new]), np.insert(self.place, at[new], places)
            self.parts.append(read(new))

    def taken(self) -> pa.RecordBatch:
        none = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64)]
        language, k, text, length = (np.concatenate(c) for c in zip(none, *self.parts))
        ends = np.r_[0, np.cumsum(length)].astype(np.int32)
        names = pa.DictionaryArray.from_arrays(pa.array(language, pa.int32()), pa.array(list(self.languages), pa.string()))
        columns = [
            names.cast(pa.string()), pa.array(k, pa.int32()),
            pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text))),
            pa.array(self.n),
        ]
        self.empty()
        return pa.RecordBatch.from_arrays(columns, schema=PHRASES)


class Filter:
    """A Bloom filter over 64-bit keys, as the words of its bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (64 * len(words)).bit_length() + 1)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for probe in PROBES:
            at = (keys * probe) >> self.shift
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def filter_of(keys: DataFrame) -> Broadcast:
    """The filter over a column `key`: 16 bits a key, FILTER_BITS at most; only its words reach the driver."""
    spark = keys.sparkSession
    wanted = min(FILTER_BITS, max(1 << 12, 16 * keys.count()))
    bits = 1 << (wanted - 1).bit_length()
    shift = 65 - bits.bit_length()

    def word_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([(key * p) >> np.uint64(shift) for p in PROBES]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"]
            )

    found = keys.select("key").mapInArrow(word_bits, "word bigint, bits bigint").groupBy("word").agg(
        F.bit_or("bits").alias("bits")
    ).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(words)


def _mine_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all phrases of one and two words, per shard."""
    counts = Counts()
    for block in blocks(batches):
        for window in block.windows():
            for k in (1, 2):
                counts.add(window.keys(k))
            if len(counts.key) >= HELD_KEYS:
                yield counts.taken()
    yield counts.taken()


def _mine_long(frequent: Broadcast):
    """Counts of the phrases of three words of which both halves are frequent in the shard."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, counts = Filter(frequent.value), Counts()
        for block in blocks(batches):
            for window in block.windows():
                half = np.zeros(window.n + 1, bool)
                half[window.at[2]] = passing.passes(window.keys(2))
                at = window.at[3]
                # The second half of the last phrase may begin in the next window; it is not tested there.
                beyond = at + 1 >= window.n
                counts.add(window.keys(3)[half[at] & (half[np.minimum(at + 1, window.n)] | beyond)])
                if len(counts.key) >= HELD_KEYS:
                    yield counts.taken()
        yield counts.taken()

    return mine


PHRASES = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
PHRASES_DDL = "lang string, k int, phrase string, n bigint"


def _count(candidates: Broadcast):
    """Occurrences of the candidates by their text, and of all words of a language as k = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, held = Filter(candidates.value), Phrases()
        for block in blocks(batches):
            numbers = np.array([held.number(x) for x in block.languages], np.int32)
            of_languages = np.bincount(numbers[block.document], minlength=len(held.languages))
            for language, number in held.languages.items():
                if of_languages[number]:
                    held.add(
                        np.array([language_salt(language)]), of_languages[[number]],
                        lambda _, x=number: (np.array([x], np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint8), np.zeros(1, int)),
                    )
            for window in block.windows():
                for k in (1, 2, 3):
                    keys = window.hashes[k] & ~np.uint64(3)
                    some = np.flatnonzero(passing.passes(keys))
                    found, first, counts = np.unique(keys[some], return_index=True, return_counts=True)
                    at = window.at[k][some[first]] + window.low

                    def read(new: np.ndarray) -> tuple:
                        text, length = block.phrases(at[new], k)
                        return numbers[block.document[at[new]]], np.full(len(new), k, np.int32), text, length

                    held.add(found, counts, read)
                if len(held.n) >= HELD_PHRASES:
                    yield held.taken()
        yield held.taken()

    return count


def _frequent(rows: DataFrame, counted, support: int, name: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Tasks have combined their rows already, so they are dealt out as they are.
    counts = rows.mapInArrow(counted, COUNTED_DDL).repartition(parts, "key").groupBy("key").agg(F.sum("n").alias("n"))
    return materialize(counts.where(F.col("n") >= support).select("key"), name)


def phrase_counts(docs: DataFrame, support: int = 10, shards: int = SHARDS, text_column: str = "text",
                  language_column: str = "lang") -> DataFrame:
    """(lang, k, phrase, n): occurrences of every phrase of one to three words with at least `support`, by language;
    k = 0 is a row per language with all its word occurrences."""
    if not 1 <= shards <= 4:
        raise ValueError("a shard takes two bits of a key: 1 to 4 shards")
    text, language = F.col(f"`{text_column}`"), F.col(f"`{language_column}`").cast("string")
    rows = docs.select(
        F.coalesce(text, F.lit("")).alias("text"), F.coalesce(language, F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]), F.lit(shards))
        .cast("int").alias("shard"),
    )
    lowered = -(-support // shards)
    short = _frequent(rows, _mine_short, lowered, "short")
    long = _frequent(rows, _mine_long(filter_of(short)), lowered, "long")
    union = short.unionByName(long).select(F.col("key").bitwiseAND(~3).alias("key")).distinct()
    counted = rows.mapInArrow(_count(filter_of(materialize(union, "candidates"))), PHRASES_DDL)
    counts = counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return materialize(counts.where((F.col("k") == 0) | (F.col("n") >= support)), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of two and three words, by their lowest-scoring cut."""

    def after(phrase: Column, words: int) -> Column:
        first = F.char_length(F.substring_index(phrase, " ", words))
        return F.substring(phrase, first + 2, F.char_length(phrase))

    phrase = F.col("phrase")

    def cut(at: int) -> Column:
        return F.struct(
            F.lit(at).alias("cut"), F.substring_index(phrase, " ", at).alias("first"), after(phrase, at).alias("rest")
        )

    cuts = F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    rows = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(cuts).alias("c"))
    sizes = counts.where("k BETWEEN 1 AND 2")
    left = sizes.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = sizes.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    a, l, r = (F.col(c).cast("decimal(20,0)") for c in "alr")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r)
    joined = rows.select("lang", "phrase", "k", "a", "c.*").join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    lowest = joined.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("lowest")
    )
    return lowest.select("lang", "phrase", "k", "a", "lowest.l", "lowest.r", "lowest.score")


def collocations(
    docs: DataFrame, support: int = 10, top: int = 2000, shards: int = SHARDS,
    text_column: str = "text", language_column: str = "lang",
) -> DataFrame:
    """Each language's `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is dropped when a longer candidate holds it with at least half its occurrences. Null texts are empty, null
    languages are `und`; repeated rows count as often as they occur; further columns only help to deal out the rows. Ties
    in score and occurrences go by the phrase's bytes. A table without phrases has no rows. Numbers are exact while
    1,000,000 * a * a has at most 38 digits. Two phrases of equal 64-bit hash in one block would be counted as one.
    """
    counts = phrase_counts(docs, support, shards, text_column, language_column)
    rows = materialize(scored(counts), "scored")
    phrase = F.col("phrase")
    inner = F.array(F.substring_index(phrase, " ", 2), F.substring_index(phrase, " ", -2))
    longer = rows.where("k = 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("_longer")
    )
    kept = rows.join(longer, ["lang", "phrase"], "left").where("_longer IS NULL OR k = 3 OR 100 * _longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    for by in (["lang", "_part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        ranked = ranked.where(F.col("rank") <= top)
    words = counts.where("k = 0").select("lang", F.col("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS p FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
), f AS (SELECT lang, k, p, count(*)::HUGEINT AS n FROM grams GROUP BY lang, k, p HAVING count(*) >= 10),
cuts AS (
  SELECT lang, k, p, n AS a, unnest(range(1, k)) AS cut, string_split(p, ' ') AS w FROM f WHERE k > 1
), scores AS (
  SELECT c.lang, c.k, c.p, c.a, c.cut, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:c.cut], ' ') AND x.k = c.cut
  JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[c.cut + 1:c.k], ' ') AND y.k = c.k - c.cut
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f t WHERE t.lang = s.lang AND s.k = 2 AND t.k = 3 AND 100 * t.n >= 50 * s.a
    AND (t.p[1:length(s.p) + 1] = s.p || ' ' OR t.p[length(t.p) - length(s.p):] = ' ' || s.p))
), words AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang)
SELECT lang, rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) JOIN words USING (lang)
WHERE rank <= 2000
"""
