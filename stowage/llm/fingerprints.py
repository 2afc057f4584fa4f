"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph ends at a line break. A section ends at a blank line, or after a paragraph whose
digest says so, so that an edit moves no later border. Long paragraphs are cut into
pieces after spaces whose eight preceding bytes say so; far behind the last border any four bytes
may say so, and no piece is longer than `MOST`. The first line of a text is also cut at `HEAD`, so
that short texts have several pieces too. What lies behind a border never moves it. Every node is the digest of its children;
two texts are equal when the roots are, and the branches that differ hold the edits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stowage.llm.ranges import range_of

#: A piece ends after one word in PIECE, a section after one paragraph in SECTION.
PIECE, SECTION = 8, 8
#: A piece may end after one byte in ANY once it is FAR long, and does after MOST bytes.
ANY, FAR, MOST = 64, 128, 256
#: Places in the first line that are borders whatever it says.
HEAD = np.array([2, 4, 8, 16, 32, 64, 128])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    root: str
    sections: list[list[list[str]]]  # pieces by paragraph by section, 8 hexadecimal digits each

    def text(self) -> str:
        body = ";".join(",".join("".join(p) for p in section) for section in self.sections)
        return f"{self.root}:{body}"

    @staticmethod
    def parse(text: str) -> Tree:
        root, _, body = text.partition(":")
        sections = [
            [[p[i : i + 8] for i in range(0, len(p), 8)] for p in section.split(",")]
            for section in body.split(";") if section
        ]
        return Tree(root, sections)

    def pieces(self) -> list[str]:
        return [piece for section in self.sections for paragraph in section for piece in paragraph]


def chosen(padded: np.ndarray, ends: np.ndarray, window: int, one_in: int) -> np.ndarray:
    """The ends whose last `window` bytes hash to one in `one_in`; the text has 8 bytes of padding before it."""
    mixed = np.zeros(len(ends), np.uint64)
    for k in range(window, 0, -1):
        mixed = mixed * np.uint64(257) + padded[ends + (8 - k)]
    mixed *= np.uint64(11400714819323198485)
    return ends[(mixed >> np.uint64(40)) % np.uint64(one_in) == 0]


def inside(ends: np.ndarray, first: int, step: int) -> np.ndarray:
    """Places `first`, `first + step`, ... behind each end that lie before the next end."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - starts - first + step - 1, 0) // step
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts + first, counts) + number * step


def borders(text: bytes) -> np.ndarray:
    """Ends of the pieces."""
    data = np.frombuffer(text, np.uint8)
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    spaces = chosen(padded, np.flatnonzero(data == 0x20), 8, PIECE) + 1
    lines = np.flatnonzero(data == 0x0A) + 1
    first = lines[0] if len(lines) else len(text)
    ends = np.unique(np.concatenate([spaces, lines, HEAD[first > HEAD], [len(text)]]))
    ends = np.union1d(ends, chosen(padded, inside(ends, FAR, 1), 4, ANY))
    return np.union1d(ends, inside(ends, MOST, MOST))


def tree_of(text: str) -> Tree:
    """The tree of a whole text; the empty text has a root and no sections."""
    data = text.encode()
    sections, section_nodes = [], []
    paragraphs, paragraph_nodes, pieces, nodes = [], [], [], []

    def close_section() -> None:
        nonlocal paragraphs, paragraph_nodes
        sections.append(paragraphs)
        section_nodes.append(digest(b"S" + b"".join(paragraph_nodes)))
        paragraphs, paragraph_nodes = [], []

    def close_paragraph() -> None:
        nonlocal pieces, nodes
        node = digest(b"P" + b"".join(nodes))
        paragraphs.append(pieces)
        paragraph_nodes.append(node)
        pieces, nodes = [], []

    begin = 0
    for end in borders(data).tolist() if data else []:
        node = digest(data[begin:end])
        nodes.append(node)
        pieces.append(node[:4].hex())
        if data[end - 1] == 0x0A:
            blank = end - begin == 1 and len(nodes) == 1
            close_paragraph()
            if blank or paragraph_nodes[-1][0] % SECTION == 0:
                close_section()
        begin = end
    if nodes:
        close_paragraph()
    if paragraphs:
        close_section()
    return Tree(digest(b"R" + b"".join(section_nodes)).hex(), sections)


def likeness(one: Tree, other: Tree) -> float:
    """1 for equal roots, else the share of pieces both trees have (twice the common over all)."""
    if one.root == other.root:
        return 1.0
    a, b = one.pieces(), other.pieces()
    if not a or not b:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    return min(2.0 * common / (len(a) + len(b)), 1.0)


def edits(one: str, other: str) -> list[tuple[int, int, int]]:
    """Places (section, paragraph, piece) of the first fingerprint that the second one lacks.

    Goes down only into branches the other tree does not have as a whole.
    """
    a, b = Tree.parse(one), Tree.parse(other)
    if a.root == b.root:
        return []
    sections = Counter(str(s) for s in b.sections)
    paragraphs = Counter(str(p) for s in b.sections for p in s)
    pieces = Counter(b.pieces())
    out = []
    for i, section in enumerate(a.sections):
        if sections[str(section)]:
            continue
        for j, paragraph in enumerate(section):
            if not paragraphs[str(paragraph)]:
                out += [(i, j, k) for k, piece in enumerate(paragraph) if not pieces[piece]]
    return out


@F.pandas_udf(T.StringType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([tree_of(t).text() for t in batch], dtype=object)


@F.pandas_udf(T.DoubleType())
def fingerprint_likeness(one: pd.Series, other: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns."""
    return pd.Series([likeness(Tree.parse(a), Tree.parse(b)) for a, b in zip(one, other)], dtype=float)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and fingerprint of every row; a null text counts as empty, repeated rows stay repeated."""
    return docs.select(
        id_column, _fingerprint(F.coalesce(F.col(text_column), F.lit(""))).alias("fingerprint")
    )


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
EDITED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(doc_id: int | None, text: str, tree: Tree, next_text: str, next_tree: Tree) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + next_text[:cut]
    edited_tree = tree if edited == text else tree_of(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.text(),
        edited_tree.text(), likeness(tree, edited_tree), likeness(tree, next_tree),
    )


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (doc_id, text); the last is the first row of the next range and only looked at."""
    held = None
    for batch in batches:
        out = []
        for doc_id, text, peek in zip(*(batch.column(c).to_pylist() for c in range(3))):
            tree = tree_of(text)
            if held is not None:
                out.append(_compare(*held, text, tree))
            held = None if peek else (doc_id, text, tree)
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), EDITED_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, schema=EDITED_ARROW)


def compare_with_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next document.

    The edited form has the last quarter replaced by the beginning of the next document in
    (doc_id, text) order, null ids first; the last document is followed by the first. Null texts
    are empty; a text of under four characters stays as it is; a single document follows
    itself. Repeated rows are neighbours of each other.

    The texts are shuffled once, into ranges of ids that are sorted and read as a stream.
    A range also gets a copy of the first row of the range after it. `ranges`
    defaults to the session's shuffle partitions; the driver holds that many ids.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    splits = rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    rows = rows.withColumn("_range", range_of(F.col("doc_id"), sorted(set(splits))))
    # Smallest id per range, null when the range has null ids: at most `ranges` rows.
    begins = sorted(
        rows.groupBy("_range")
        .agg(F.min("doc_id").alias("id"), F.max(F.isnull("doc_id")).alias("null")).collect()
    )
    ids = [(r["_range"], None if r["null"] else r["id"]) for r in begins]
    before = {here: ids[i - 1][0] for i, (here, _) in enumerate(ids)}
    table = spark.createDataFrame(
        [(i, here, before[here]) for here, i in ids], "_id bigint, _here int, _before int"
    )
    firsts = rows.join(
        F.broadcast(table), (F.col("_range") == F.col("_here")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    peeks = firsts.groupBy("_before").agg(F.min("text").alias("text"))
    both = rows.withColumn("_peek", F.lit(False)).unionByName(
        peeks.select(
            F.lit(None).cast("bigint").alias("doc_id"), "text",
            F.col("_before").alias("_range"), F.lit(True).alias("_peek"),
        )
    )
    return (
        both.repartitionById(ranges, "_range")
        .sortWithinPartitions("_peek", F.asc_nulls_first("doc_id"), "text")
        .select("doc_id", "text", "_peek")
        .mapInArrow(_compare_neighbours, EDITED)
    )
