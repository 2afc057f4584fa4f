"""Language identification as a mixture: every text may hold several languages.

Each language has a model of hashed byte trigrams of lower-cased letters, counted over all its
training documents. A text is cut into windows of `WINDOW` trigrams, and expectation-maximisation
estimates the share of windows each language of a set explains. The set grows from the best
single language, one language at a time, as long as the likelihood gains more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 15
WINDOW = 16
ROUNDS = 8
#: Numbers of one block of the window table a worker holds.
BLOCK = 1 << 22
#: Neighbouring trigrams share letters, so a window counts as a third of its trigrams.
OVERLAP = 3
UNKNOWN = "und"

_KEPT = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams with a letter in them, in order."""
    data = np.frombuffer((" " + text.lower() + " ").encode().translate(_KEPT), np.uint8).astype(np.uint32)
    triple = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    triple = triple[triple != 0x202020]
    return (triple * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS, languages: log-probabilities over OVERLAP


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a whole partition: one array per language is held."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in range(2))):
            found = trigrams(text)
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            if len(found) < BUCKETS // 8:
                np.add.at(counts[lang], found, 1)
            else:
                counts[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], schema=COUNTS
        )


def fold(id_column: str):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def train_languages(docs: DataFrame) -> LanguageModel:
    """Models of all languages from all training documents: text and lang given, id's crc32 mod 4 not 2.

    The counts are summed where the texts are; the driver gets BUCKETS numbers per language.
    """
    usable = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(fold("doc_id"), F.lit(2)) != 2)
    )
    counts = (
        usable.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(counts["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[counts["bucket"], counts["lang"].map(place)] += counts["n"]
    return LanguageModel(languages, (np.log(table / table.sum(0)) / OVERLAP).astype(np.float32))


def window_scores(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each window under each language, and the number of windows per text."""
    found = [trigrams(t) for t in texts]
    begins = [np.arange(0, len(f), WINDOW) for f in found]
    sizes = np.array([len(b) for b in begins])
    if not sizes.sum():
        return np.zeros((0, len(model.languages)), np.float32), sizes
    before = np.r_[0, np.cumsum([len(f) for f in found])[:-1]]
    at = np.concatenate([b + offset for b, offset in zip(begins, before)])
    return np.add.reduceat(model.table[np.concatenate(found)], at, axis=0), sizes


def mixtures(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares (texts, languages) of the selected languages; rows without windows are all 0.

    A language joins a text's set when it adds more than 3 + log(windows) to the log-likelihood.
    """
    texts, languages = len(sizes), scores.shape[1]
    out = np.zeros((texts, languages))
    rows = np.flatnonzero(sizes)
    if not len(rows) or not languages:
        return out
    n = sizes[rows]
    begin = np.r_[0, np.cumsum(n)[:-1]]
    top = scores.max(1, keepdims=True)
    weight = np.exp((scores - top).astype(np.float64))
    top = np.add.reduceat(top.ravel().astype(np.float64), begin)

    def share(allowed: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihood of the active texts, by EM from equal shares."""
        window = np.concatenate([np.arange(b, b + k) for b, k in zip(begin[active], n[active])])
        starts = np.r_[0, np.cumsum(n[active])[:-1]]
        likely = weight[window]
        p = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            joint = np.repeat(p, n[active], axis=0) * likely + 1e-300
            joint /= joint.sum(1, keepdims=True)
            p = np.add.reduceat(joint, starts, axis=0) / n[active][:, None]
            p = np.where(allowed, p, 0)
            p /= p.sum(1, keepdims=True)
        total = np.log((np.repeat(p, n[active], axis=0) * likely).sum(1) + 1e-300)
        return p, np.add.reduceat(total, starts) + top[active]

    everyone = np.arange(len(rows))
    alone = np.add.reduceat(scores.astype(np.float64), begin, axis=0)
    chosen = np.zeros((len(rows), languages), bool)
    chosen[everyone, alone.argmax(1)] = True
    best, shares = alone.max(1), chosen.astype(float)
    free, _ = share(np.ones_like(chosen), everyone)
    active = everyone
    for _ in range(languages - 1):
        rest = np.where(chosen[active], -1, free[active])
        active = active[rest.max(1) * n[active] >= 1]  # less than one window's worth never pays
        if not len(active):
            break
        tried = chosen[active]
        tried[np.arange(len(active)), np.where(tried, -1, free[active]).argmax(1)] = True
        p, likelihood = share(tried, active)
        gains = likelihood - best[active] > 3 + np.log(n[active])
        active, p = active[gains], p[gains]
        chosen[active], shares[active], best[active] = tried[gains], p, likelihood[gains]
    out[rows] = shares
    return out


def blocks(texts: list[str], languages: int) -> Iterator[list[str]]:
    """Texts whose trigram table stays near BLOCK numbers, at least one at a time."""
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text) * max(languages, 1)
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def language_mixtures(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id") -> DataFrame:
    """Id and `languages`: array of (lang, share) of the selected languages, largest share first.

    Null texts and texts without a letter have an empty array, and so has everything under a
    model without languages. Rows are judged one by one; repeated rows get equal results.
    """

    @F.pandas_udf("array<struct<lang:string,share:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for texts in blocks(batch.tolist(), len(model.languages)):
                for row in mixtures(*window_scores(model, texts)):
                    order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    out.append([{"lang": model.languages[i], "share": float(row[i])} for i in order])
            yield pd.Series(out, dtype=object)

    text = F.col("text")
    letters = F.when(text.rlike(r"\p{L}"), text).otherwise("")
    return docs.select(id_column, judge(F.coalesce(letters, F.lit(""))).alias("languages"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Language with the largest share of each text and that share; `und` with 0 where there is none."""
    found = language_mixtures(docs.select("doc_id", "text"), train_languages(docs))
    first = F.get("languages", F.lit(0))
    return found.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.least(F.coalesce(first["share"], F.lit(0.0)), F.lit(1.0)).alias("score"),
        "languages",
    )
