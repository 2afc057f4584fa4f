"""Names and types of the columns of many CSV files, in one job that reads every file once.

Files are read in blocks that begin behind a line break. Whether that break ends a record or stands inside quotes is
not known there, so a block is described for both cases: where its first record ends and its last, open one
begins, which case the next block is in, and the types that fit the values of its whole records. Those descriptions are
small; they are folded per file, in order of the blocks, each with the case the blocks before it lead to. A record over
a border is read again by its range. Files with the extension of a compression are one unit, read from the front.

Fields are quoted as in RFC 4180: a quote opens a quoted field only where a field begins, and two of them
stand for one. Spark's own writer does so with ``escape='"'``.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import BLOCK_BYTES
from .lines import COMPRESSED, MARK
from .stores import open_input, resolve, spread

#: Types a value may fit, narrowest first; a column has the first that fits all its values, else string.
TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")
ALL = (1 << len(TYPES)) - 1
#: A record longer than this is taken for an unclosed quote.
MAX_RECORD = 16 * 1024 * 1024

WHOLE = r"^[+-]?[0-9]{1,19}$"
REAL = r"^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Inf(inity)?)$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def fitting(values: list[str]) -> int:
    """Bits of the types that all the values fit; they are not empty."""
    some = pc.unique(pa.array(values, pa.string()))

    def every(pattern: str) -> bool:
        return pc.all(pc.match_substring_regex(some, pattern)).as_py()

    fits = 0
    if every(REAL):
        fits |= 1 << TYPES.index("double")
    if fits and every(WHOLE):
        numbers = [int(v) for v in some.to_pylist()]
        for kind, bits in (("int", 31), ("bigint", 63)):
            if all(-(1 << bits) <= n < 1 << bits for n in numbers):
                fits |= 1 << TYPES.index(kind)
    if pc.all(pc.is_in(pc.utf8_lower(some), pa.array(["true", "false"]))).as_py():
        fits |= 1 << TYPES.index("boolean")
    if every(MOMENT):
        try:
            for day in pc.unique(pc.utf8_slice_codeunits(some, 0, 10)).to_pylist():
                datetime.date.fromisoformat(day)
        except ValueError:  # no such day
            return fits
        fits |= 1 << TYPES.index("timestamp")
        if every(DAY):
            fits |= 1 << TYPES.index("date")
    return fits


@dataclass
class Folded:
    """Types that fit all values of each column so far, and whether it had a value."""

    fits: list[int] = field(default_factory=list)
    seen: list[bool] = field(default_factory=list)

    def widen(self, width: int) -> None:
        self.fits += [ALL] * (width - len(self.fits))
        self.seen += [False] * (width - len(self.seen))

    def merge(self, fits: list[int], seen: list[bool]) -> None:
        self.widen(len(fits))
        for i, (f, s) in enumerate(zip(fits, seen)):
            self.fits[i] &= f
            self.seen[i] |= s

    def take(self, records: list[list[str]]) -> None:
        self.widen(max(map(len, records), default=0))
        for i in range(len(self.fits)):
            values = [r[i] for r in records if i < len(r) and r[i] != ""]
            if values:
                self.seen[i] = True
                if self.fits[i]:
                    self.fits[i] &= fitting(values)


def records_of(data: bytes, sep: str) -> list[list[str]]:
    """The fields of whole records; blank lines are none."""
    csv.field_size_limit(2**31 - 1)
    text = io.StringIO(data.decode("utf-8", "replace"), newline="")
    return [r for r in csv.reader(text, delimiter=sep) if r]


@dataclass
class Described:
    """A block in one case: end of the record it begins in (-1: not in here), begin of the one it ends in
    (-1: that ends here), whether the next block begins inside quotes, its whole records, and the last line break that
    ends a record."""

    first_end: int
    last_begin: int
    inside: bool
    whole: tuple[int, int]
    last_break: int = 0


def describe_block(data: bytes, inside: bool, sep: str) -> Described:
    """Where the records of a block lie if it begins inside quotes, or at a record."""
    quoted = re.compile(rb'(?<![^\r\n' + re.escape(sep.encode()) + rb'])"[^"]*(?:""[^"]*)*("|\Z)')
    breaks = re.compile(rb"[\r\n]")
    at, first_end = 0, 0
    if inside:
        closing = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")').match(data)
        if not closing:
            return Described(-1, -1, True, (0, 0))
        at, first_end = closing.end(), -1
    begin, opened = 0, None  # of the first record in the block, and of a quoted field that stays open
    spans = []
    for found in quoted.finditer(data, at):
        spans.append(found.span())
        if not found.group(1):
            opened = found.start()
    # Line breaks outside the quoted spans end records.
    edges = [at, *(x for s in spans for x in s), len(data)]
    gaps = list(zip(edges[::2], edges[1::2]))
    if inside:
        first_end = next((m.end() for a, b in gaps if (m := breaks.search(data, a, b))), -1)
        if first_end < 0:
            return Described(-1, -1, opened is not None, (0, 0))
        begin = first_end
    last = begin
    for a, b in reversed(gaps):
        at = max(data.rfind(b"\n", a, b), data.rfind(b"\r", a, b)) + 1
        if at:
            last = max(at, begin)
            break
    if opened is None:
        return Described(first_end, -1, False, (begin, len(data)), last)
    return Described(first_end, last, True, (begin, last), last)


BLOCKS = (
    "path string, start bigint, inside boolean, first_end bigint, last_begin bigint, after boolean, header array<string>,"
    " fits array<int>, seen array<boolean>, size bigint, error string"
)
COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


def _rows_of_block(path: str, start: int, data: bytes, cases: tuple[bool, ...], sep: str, header: bool) -> list[tuple]:
    rows = []
    for inside in cases:
        found = describe_block(data, inside, sep)
        records = records_of(data[slice(*found.whole)], sep)
        names = records.pop(0) if header and not inside and records else None
        folded = Folded()
        folded.take(records)
        places = [start + x if x >= 0 else -1 for x in (found.first_end, found.last_begin)]
        rows.append((path, start, inside, *places, found.inside, names, folded.fits, folded.seen, len(data), None))
    return rows


def _lines_from(source, start: int, end: int) -> tuple[int, bytes]:
    """The bytes between the line breaks that follow `start` and `end`, and where they begin."""
    back = max(start - 1, 0)
    source.seek(back)
    data = source.read(end - back)
    at = 0
    if start:
        first = re.search(rb"[\r\n]", data)
        if not first:
            return start, b""
        at = first.end()
    more = b"" if re.match(rb"[\r\n]\Z", data[-1:]) else source.read(64 * 1024)
    parts = [data[at:]]
    while more:
        stop = re.search(rb"[\r\n]", more)
        parts.append(more[: stop.end()] if stop else more)
        more = b"" if stop else source.read(64 * 1024)
    return back + at, b"".join(parts)


def _described(sep: str, block: int):
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end in batch.itertuples(index=False):
                try:
                    if path.endswith(COMPRESSED):
                        rows = _packed_rows(path, sep, block)
                    else:
                        with open_input(path) as source:
                            begin, data = _lines_from(source, int(start), int(end))
                        if not start and data.startswith(MARK):
                            begin, data = len(MARK), data[len(MARK):]
                        # A first block begins at a record; any other may begin inside quotes.
                        cases = (False, True) if start else (False,)
                        rows = _rows_of_block(path, begin, data, cases, sep, not start) if data else []
                except (OSError, EOFError, ValueError, csv.Error, pa.ArrowException) as problem:
                    rows = [(path, int(start), *[None] * 8, str(problem))]
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS).astype({
                        "inside": "boolean", "after": "boolean", "first_end": "Int64", "last_begin": "Int64", "size": "Int64",
                    })

    return describe


def _packed_rows(path: str, sep: str, block: int) -> list[tuple]:
    """One row for a whole compressed file, whose blocks follow each other in one task."""
    system, place = resolve(path)
    folded, names, held = Folded(), None, b""
    with system.open_input_stream(place, compression="detect") as source:
        more = True
        while more:
            data = source.read(block)
            more = bool(data)
            held += data
            found = describe_block(held, False, sep)
            cut = len(held)
            if more:
                cut = found.last_break
                if len(held) - cut > MAX_RECORD:
                    raise ValueError(f"a record of more than {MAX_RECORD} bytes; is a quote left open?")
            records = records_of(held[:cut].removeprefix(MARK) if names is None else held[:cut], sep)
            held = held[cut:]
            if names is None and records:
                names = records.pop(0)
            folded.take(records)
    return [(path, 0, False, 0, -1, False, names, folded.fits, folded.seen, 0, None)]


FOLDED = "file string, header array<string>, fits array<int>, seen array<boolean>, error string"


@dataclass
class OfFile:
    """The blocks of one file folded in order."""

    path: str
    sep: str
    inside: bool = False
    open_begin: int = -1
    end: int = 0
    taken: int = -1
    header: list[str] | None = None
    folded: Folded = field(default_factory=Folded)
    error: str | None = None

    def record(self, end: int) -> None:
        """Read and take the record that began in an earlier block."""
        if end - self.open_begin > MAX_RECORD:
            self.error = f"a record of more than {MAX_RECORD} bytes; is a quote left open?"
            return
        with open_input(self.path) as source:
            source.seek(self.open_begin)
            data = source.read(end - self.open_begin)
        self.open_begin = -1
        records = records_of(data.removeprefix(MARK), self.sep)
        if self.header is None and records:
            self.header = records.pop(0)
        self.folded.take(records)

    def take(self, row: dict) -> None:
        if self.error is not None or row["error"] is not None:
            self.error = self.error or row["error"]
            return
        if row["inside"] != self.inside or row["start"] == self.taken:
            return  # the case that does not hold
        self.taken, self.end = row["start"], row["start"] + row["size"]
        if self.inside and row["first_end"] >= 0:
            self.record(row["first_end"])
        if row["header"] is not None:
            self.header = list(row["header"])
        self.folded.merge(list(row["fits"]), list(row["seen"]))
        if row["last_begin"] >= 0:
            self.open_begin = row["last_begin"]
        self.inside = row["after"]

    def row(self) -> tuple:
        try:
            if self.error is None and self.open_begin >= 0:
                self.record(self.end)
        except (OSError, csv.Error, pa.ArrowException) as problem:
            self.error = str(problem)
        if self.error is not None:
            return self.path, None, None, None, self.error
        return self.path, self.header, self.folded.fits, self.folded.seen, None


def _fold(sep: str):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: OfFile | None = None

        def out(file: OfFile) -> pd.DataFrame:
            return pd.DataFrame([file.row()], columns=["file", "header", "fits", "seen", "error"])

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if now is None or row["path"] != now.path:
                    if now is not None:
                        yield out(now)
                    now = OfFile(row["path"], sep)
                now.take(row)
        if now is not None:
            yield out(now)

    return fold


def csv_columns(files: DataFrame, sep: str = ",", block: int = BLOCK_BYTES) -> DataFrame:
    """(file, header, fits, seen, error) of each file of (path, length); empty files have no row.

    A file that cannot be read has an `error` and nothing else.
    """
    if len(sep.encode()) != 1:
        raise ValueError("the separator has to be one ASCII character")
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|lz4)\z")
    starts = F.when(packed, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))
    )
    units = files.where("length > 0").select("path", F.explode(starts).alias("start"))
    units = spread(units.select("path", "start", (F.col("start") + block).alias("end")), "path", "start")
    blocks = units.mapInPandas(_described(sep, block), BLOCKS)
    ordered = spread(blocks, "path").sortWithinPartitions("path", "start", "inside")
    return ordered.mapInPandas(_fold(sep), FOLDED)


def _names(header: Column, width: Column) -> Column:
    """The header's names; columns without one are called col<N>, names that occur twice get their place."""
    place = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(i.alias("i"), F.coalesce(F.get(header, i), F.lit("")).alias("n")))

    def named(p: Column) -> Column:
        twice = F.size(F.filter(header, lambda h: F.lower(h) == F.lower(p["n"]))) > 1
        return F.when(p["n"] == "", F.concat(F.lit("col"), (p["i"] + 1).cast("string"))).otherwise(
            F.when(twice, F.concat(p["n"], p["i"].cast("string"))).otherwise(p["n"])
        )

    return F.transform(place, named)


def _type(fits: Column, seen: Column) -> Column:
    kind = F.lit("string")
    for i in reversed(range(len(TYPES))):
        kind = F.when(fits.bitwiseAND(1 << i) != 0, F.lit(TYPES[i])).otherwise(kind)
    return F.when(seen, kind).otherwise("string")


def described_columns(folded: DataFrame, by: Column | None = None) -> DataFrame:
    """(file, ordinal, name, type, error) from `csv_columns`, one row per column.

    With `by`, the files that give one value (such as their folder) are one table: a column has the type that
    fits the values of all of them, and the name it has in the file first by name.
    """
    width = F.greatest(F.size("header"), F.size("fits"))
    group = F.col("file") if by is None else by
    wide = folded.where("error IS NULL AND header IS NOT NULL").select(
        group.alias("group"), "file", F.posexplode(_names(F.col("header"), width)).alias("ordinal", "name"), "fits", "seen"
    )
    cells = wide.select(
        "group", "file", "ordinal", "name",
        F.coalesce(F.get("fits", F.col("ordinal")), F.lit(ALL)).alias("fits"),
        F.coalesce(F.get("seen", F.col("ordinal")), F.lit(False)).alias("seen"),
    )
    merged = cells.groupBy("group", "ordinal").agg(
        F.min(F.struct("file", "name")).alias("first"), F.bit_and("fits").alias("fits"), F.bool_or("seen").alias("seen")
    )
    described = merged.select(
        F.col("group").alias("file"), F.col("ordinal").cast("int").alias("ordinal"), F.col("first.name").alias("name"),
        _type(F.col("fits"), F.col("seen")).alias("type"), F.lit(None).cast("string").alias("error"),
    )
    bad = folded.where("error IS NOT NULL").select(
        "file", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("type"), "error",
    )
    return described.unionByName(bad)
