"""Secret scans from built-in expressions: known shapes, and a battery of randomness tests.

A candidate is a run of at least `MIN_RUN` letters, digits and `+/_-`. Its encoding
is the narrowest alphabet that holds its characters. Three tests compare it with
ordinary writing (words, names, numbers), which is their null hypothesis:

* uniformity: the chi-squared statistic against equally frequent symbols. Writing
  repeats its favourite symbols, so the statistic of a run of n characters has a mean
  of k - 1 + (n - 1) * `excess` under the null; secrets stay near k - 1.
* runs: how often the character class changes between neighbours. Writing keeps
  letters and digits in blocks and changes class at a rate of `CLASS_CHANGE`. In an alphabet
  of one class the halves are vowels and consonants, which writing alternates more often than
  chance does, or digits below and from 5.
* serial correlation of neighbouring symbol numbers, `SERIAL` under the null.

The null of digits alone is chance itself, since ordinary numbers look like it: a decimal secret
cannot be told from them. Stouffer's sum of the scores gives one p-value. Discoveries are controlled by
the Benjamini-Hochberg rule over all candidates of the input, within strata of encoding
and length, so that the many short runs neither hide nor excuse the long ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The shapes, their group that is measured, and its least length.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: These two match to the end of a run of their characters, so a run that is too short holds no match at
#: all: the least length stands in the pattern, and the many short runs in words are not listed.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHAPES = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
KINDS = [*SHAPES, "random"]

MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_="
CLASS_CHANGE = 0.15
SERIAL = 0.5
#: Changes between vowels and consonants, and serial correlation, of joined words in four languages.
VOWEL_CHANGE, LETTER_SERIAL = 0.57, -0.1
#: Encoding: pattern, symbols, several classes, excess of the chi-squared mean per character,
#: changes of class (or half) per neighbour, serial correlation.
#: The excess is symbols * (sum of squared frequencies) - 1 of English letters or of digits.
ENCODINGS = {
    "decimal": ("[0-9]+", 10, False, 0.0, 0.5, 0.0),
    "lower": ("[a-z]+", 26, False, 0.7, VOWEL_CHANGE, LETTER_SERIAL),
    "upper": ("[A-Z]+", 26, False, 0.7, VOWEL_CHANGE, LETTER_SERIAL),
    "hex": ("[0-9a-f]+|[0-9A-F]+", 16, True, 0.6, CLASS_CHANGE, SERIAL),
    "base32": ("[A-Z2-7]+", 32, True, 1.1, CLASS_CHANGE, SERIAL),
    "base36": ("[0-9a-z]+|[0-9A-Z]+", 36, True, 1.4, CLASS_CHANGE, SERIAL),
    "letters": ("[A-Za-z]+", 52, True, 2.4, CLASS_CHANGE, SERIAL),
    "base62": ("[0-9A-Za-z]+", 62, True, 3.1, CLASS_CHANGE, SERIAL),
    "base64": (".+", 64, True, 3.2, CLASS_CHANGE, SERIAL),
}
CLASSES = (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0aA]+", "+"))
HALVES = (("[0-4]+", "0"), ("[5-9]+", "5"), ("(?i)[aeiou]+", "a"), ("(?i)[b-df-hj-np-tv-z]+", "b"))
#: p-values are held as whole tenths of a decade, rounded towards 1.
DEEPEST = 400
SPAN = "array<struct<start:int,end:int>>"
TESTED = "array<struct<start:int,end:int,test:struct<stratum:string,depth:int>>>"
#: Values of one block of a running sum, and code points of one slice of a text that is cut up.
BLOCK, SLICE = 256, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Each value combined with all before it. Lists are only appended to within blocks of BLOCK values
    and over the blocks, so the work does not grow with the square of the number of values."""
    def begin(kind: str) -> Column:
        return F.struct(zero.alias("all"), F.array().cast(f"array<{kind}>").alias("each"))

    def inside(state: Column, value: Column) -> Column:
        return let(
            combine(state["all"], value),
            lambda now: F.struct(now.alias("all"), F.concat(state["each"], F.array(now)).alias("each")),
        )

    def before(state: Column, block: Column) -> Column:
        return F.struct(
            combine(state["all"], block["all"]).alias("all"), F.concat(state["each"], F.array(state["all"])).alias("each")
        )

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, begin("int"), before, lambda state: state["each"])
        return F.flatten(F.zip_with(
            blocks, offsets, lambda block, offset: F.transform(block["each"], lambda value: combine(offset, value))
        ))

    def cut(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.aggregate(F.slice(values, i * BLOCK + 1, F.lit(BLOCK)), begin("int"), inside),
        )

    return let(let(values, cut), joined)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end (code points, end exclusive), text and length of a group of each match, leftmost and non-overlapping.

    The matches and the text between them alternate, so their lengths add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: p["gap"] + F.char_length(p["match"]))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        return F.zip_with(
            parts, ends,
            lambda p, end: F.struct(
                (end - F.char_length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match"),
                p["group"].alias("group"),
            ),
        )

    parts = F.arrays_zip(
        F.transform(between, F.char_length).alias("gap"), found.alias("match"),
        F.transform(measured, F.char_length).alias("group"),
    )
    # There is one more piece between the matches than matches.
    return let(F.filter(parts, lambda p: p["match"].isNotNull()), placed)


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Start and end of each match of which `group` is at least `least` long."""
    kept = F.filter(matches(text, pattern, group), lambda m: m["group"] >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"], m["end"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def merged_spans(spans: Column) -> Column:
    """Spans in order of their start with those that touch or overlap as one, as (start, end)."""

    def closed(parts: Column) -> Column:
        # A span opens one if no end before reaches it, and closes it if its reach ends before the next.
        reach = F.transform(parts, lambda p: p["reach"])
        before = F.concat(F.array(F.lit(-1)), F.slice(reach, 1, F.greatest(F.size(reach) - 1, F.lit(0))))
        after = F.slice(F.transform(parts, lambda p: p["start"]), 2, F.size(parts))
        opening = F.filter(
            F.zip_with(parts, before, lambda p, r: F.when(p["start"] > r, p["start"])), lambda s: s.isNotNull()
        )
        closing = F.filter(
            F.zip_with(parts, after, lambda p, s: F.when(s.isNull() | (s > p["reach"]), p["reach"])), lambda e: e.isNotNull()
        )
        return F.zip_with(opening, closing, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    def reached(some: Column) -> Column:
        ends = F.transform(some, lambda s: s["end"])
        return F.zip_with(
            some, running(ends, F.greatest, F.lit(0)),
            lambda s, reach: F.struct(s["start"].alias("start"), reach.alias("reach")),
        )

    merged = let(let(spans, reached), closed)
    return F.when(F.size(spans) > 0, merged).otherwise(F.array().cast(SPAN))


def uncovered(runs: Column, spans: Column) -> Column:
    """The runs, in order of their start, that the spans (in order of theirs) leave a character of."""

    def marked(both: Column) -> Column:
        # The last merged span that begins no later than a run is the only one that can cover it.
        reach = running(F.transform(both, lambda b: b["reach"]), F.greatest, F.lit(-1))
        kept = F.zip_with(both, reach, lambda b, end: F.when(b["run"]["end"] > end, b["run"]))
        return F.filter(kept, lambda run: run.isNotNull())

    def together(of: Column) -> Column:
        covers = F.transform(of["spans"], lambda s: F.struct(
            s["start"].alias("start"), F.lit(0).alias("later"), s["end"].alias("reach"),
            F.when(F.lit(False), F.get(of["runs"], F.lit(0))).alias("run"),
        ))
        tested = F.transform(of["runs"], lambda r: F.struct(
            r["start"].alias("start"), F.lit(1).alias("later"), F.lit(-1).alias("reach"), r.alias("run"),
        ))
        return F.array_sort(F.concat(covers, tested))

    both = F.struct(runs.alias("runs"), merged_spans(spans).alias("spans"))
    return F.when(F.size(runs) > 0, let(let(both, together), marked)).otherwise(runs)


def depth_of(score: Column) -> Column:
    """P(N(0,1) > score) in whole tenths of decades, 0 to DEEPEST.

    The closed approximation of the tail is good to about one percent.
    """
    def of_tail(score: Column, tail: Column) -> Column:
        p = F.when(score >= 0, tail).otherwise(1 - tail)
        return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(DEEPEST)).cast("int")

    return let(score, lambda z: let(0.5 * F.exp(-0.717 * F.abs(z) - 0.416 * z * z), lambda t: of_tail(z, t)))


def uniformity(run: Column, characters: Column, n: Column, symbols: Column, excess: Column) -> Column:
    """How far the chi-squared statistic stays below that of writing, in standard deviations."""
    squares = F.aggregate(
        F.array_distinct(characters), F.lit(0.0),
        lambda total, c: total + F.pow(n - F.char_length(F.replace(run, c, F.lit(""))), F.lit(2.0)),
    )
    shift = (n - 1) * excess
    return (symbols - 1 + shift - (symbols * squares / n - n)) / F.sqrt(2 * (symbols - 1) + 4 * shift)


def changes(run: Column, classes: tuple[tuple[str, str], ...]) -> Column:
    """Number of neighbours of different classes."""
    for some, one in classes:
        run = F.regexp_replace(run, some, one)
    return F.char_length(run) - 1


def class_runs(run: Column, n: Column, several: Column, rate: Column) -> Column:
    """How far the changes of character class exceed those of writing, or those of half fall short."""
    expected = (n - 1) * rate
    excess = F.when(several, changes(run, CLASSES) - expected).otherwise(expected - changes(run, HALVES))
    return excess / F.sqrt(expected * (1 - rate))


def serial_correlation(characters: Column, n: Column, usual: Column) -> Column:
    """How far the correlation of neighbouring symbol numbers stays below that of writing."""
    numbers = F.transform(characters, lambda c: F.instr(F.lit(SYMBOLS), c).cast("double"))

    def of_centred(x: Column) -> Column:
        power = F.aggregate(x, F.lit(0.0), lambda total, a: total + a * a)
        product = F.aggregate(
            F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: a * b),
            F.lit(0.0), lambda total, a: total + F.coalesce(a, F.lit(0.0)),
        )
        return let(power, lambda p: F.when(p > 0, product / p).otherwise(1.0))

    def of_numbers(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda total, a: total + a) / n
        return let(let(mean, lambda m: F.transform(x, lambda a: a - m)), of_centred)

    return (usual - let(numbers, of_numbers)) * F.sqrt(n) / F.sqrt(1 - usual * usual)


def battery(run: Column) -> Column:
    """Struct (stratum, depth) of a run: depth is the p-value in tenths of decades, 0 to DEEPEST."""
    inferred = None
    for name, (pattern, symbols, several, excess, change, serial) in ENCODINGS.items():
        value = F.struct(
            F.lit(name).alias("name"), F.lit(float(symbols)).alias("symbols"),
            F.lit(several).alias("several"), F.lit(excess).alias("excess"),
            F.lit(change).alias("change"), F.lit(serial).alias("serial"),
        )
        fits = run.rlike(f"^(?:{pattern})$")
        inferred = F.when(fits, value) if inferred is None else inferred.when(fits, value)

    def tested(e: Column, characters: Column, n: Column) -> Column:
        uniform = uniformity(run, characters, n, e["symbols"], e["excess"])
        blocks = class_runs(run, n, e["several"], e["change"])
        score = (uniform + blocks + serial_correlation(characters, n, e["serial"])) / F.sqrt(F.lit(3.0))
        band = F.least(F.floor(F.log2(n / MIN_RUN) * 2), F.lit(20)).cast("string")
        return F.struct(F.concat_ws(":", e["name"], band).alias("stratum"), depth_of(score).alias("depth"))

    return let(
        F.struct(
            inferred.alias("encoding"),
            F.regexp_extract_all(run, F.lit("."), F.lit(0)).alias("characters"),
            F.char_length(run).cast("double").alias("n"),
        ),
        lambda r: tested(r["encoding"], r["characters"], r["n"]),
    )


def run_spans(text: Column) -> Column:
    """Candidates with their place, stratum and depth."""
    tested = F.transform(
        matches(text, RUN),
        lambda m: F.struct(m["start"], m["end"], let(m["match"], battery).alias("test")),
    )
    return F.when(text.rlike(RUN), tested).otherwise(F.array().cast(TESTED))


def discovery_cuts(candidates: DataFrame, rate: float) -> DataFrame:
    """One row with a map from stratum to the least depth that counts as a discovery.

    Benjamini-Hochberg on the histogram of each stratum: the shallowest depth whose p-value
    is at most `rate` times the share of candidates at that depth or deeper. The histogram has at
    most 9 encodings * 21 bands * (DEEPEST + 1) rows whatever the input.
    """
    counts = candidates.groupBy("stratum", "depth").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    deeper = whole.orderBy(F.desc("depth"))
    ranked = counts.select(
        "stratum", "depth",
        (F.sum("n").over(deeper) / F.sum("n").over(whole)).alias("share"),
    )
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("depth") / 10) <= rate * F.col("share"))
    cuts = passing.groupBy("stratum").agg(F.min("depth").alias("depth"))
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "depth"))).alias("cuts"))


def secret_spans(docs: DataFrame, text_column: str = "text", rate: float = 0.01) -> DataFrame:
    """The input with a column `secrets`: array of (start, kind, end), by start, then kind number.

    Kinds are numbered as in `KINDS`. The first three are the known shapes; `random` are runs the
    battery discovers at a false-discovery rate of `rate` and that known shapes do not cover whole. A null
    or empty text has none. Rows, columns and repeated rows stay as they are; an input
    column named `secrets` is replaced.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    candidates = docs.select(F.explode(run_spans(text)).alias("c")).select("c.test.*")
    cuts = discovery_cuts(candidates, rate).scalar()

    def of_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"]))

    base = F.array_sort(
        F.concat(*[of_kind(match_spans(text, *shape), k) for k, shape in enumerate(SHAPES.values())])
    )

    def discovered(shaped: Column, runs: Column, cut: Column) -> Column:
        deep = F.filter(
            runs,
            lambda r: r["test"]["depth"] >= F.coalesce(F.try_element_at(cut, r["test"]["stratum"]), F.lit(DEEPEST + 1)),
        )
        return of_kind(let(deep, lambda some: uncovered(some, shaped)), len(SHAPES))

    names = [c for c in docs.columns if c != "secrets"]
    own = {"_base": base, "_runs": run_spans(text), "_cuts": cuts}
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")
    found = docs.select(whole, *[v.alias(k) for k, v in own.items()]).select(
        "_doc",
        F.array_sort(
            F.concat(F.col("_base"), discovered(F.col("_base"), F.col("_runs"), F.col("_cuts")))
        ).alias("secrets"),
    )
    return found.select("_doc.*", "secrets")


def written(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: float = 0.01
) -> DataFrame:
    """One row per input row: counts of the known shapes, the digest of their spans, and all spans.

    Null texts count as empty: zero counts, the digest of the empty string, no spans.
    """
    found = secret_spans(docs.select(id_column, text_column), text_column, rate)
    base = F.filter("secrets", lambda s: s["kind"] < len(SHAPES))

    def number_of(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        id_column,
        *[number_of(k).alias(f"n_{kind}") for k, kind in enumerate(SHAPES)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )


def redact_secrets(
    docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]", rate: float = 0.01
) -> DataFrame:
    """The input with each found span (overlapping ones as one) replaced by `mark`."""
    found = secret_spans(docs, text_column, rate)
    text = F.col(f"`{text_column}`")

    def kept(of: Column) -> Column:
        """The text between the spans, each piece put together from the slices it lies in."""
        begins = F.concat(F.array(F.lit(0)), F.transform(of["spans"], lambda s: s["end"]))
        ends = F.concat(F.transform(of["spans"], lambda s: s["start"]), F.array(of["length"]))

        def piece(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / SLICE).cast("int"), F.floor((end - 1) / SLICE).cast("int")
            some = F.transform(
                F.sequence(first, F.greatest(first, last)),
                lambda i: F.substring(
                    F.get(of["slices"], i), F.greatest(begin - i * SLICE, F.lit(0)) + 1,
                    F.least(end - i * SLICE, F.lit(SLICE)) - F.greatest(begin - i * SLICE, F.lit(0)),
                ),
            )
            return F.when(begin < end, F.array_join(some, "")).otherwise("")

        return F.array_join(F.zip_with(begins, ends, piece), mark)

    parts = F.struct(
        merged_spans(F.col("secrets")).alias("spans"), F.char_length(text).alias("length"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)).alias("slices"),
    )
    clean = let(parts, kept)
    return found.select(
        *[
            F.when(F.size("secrets") > 0, clean).otherwise(text).alias(c)
            if c == text_column else F.col(f"`{c}`")
            for c in found.columns if c != "secrets"
        ]
    )
