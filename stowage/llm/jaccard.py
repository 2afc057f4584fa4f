"""Word-shingle Jaccard join by signature trees.

Two sets at or above the threshold differ in a bounded number of shingles. The hash space is cut into
one range more than that, so two such sets agree on at least one whole range: each set is filed under a key per
range, and sets with a common key (and sizes that allow it) make a coarse group. No pair is lost, and copies are one set.

Inside a group the sets stand in a signature tree: leaves hold a bitmap of a set's shingles, nodes the OR of
their children, and both the range of sizes below. The tree is traversed against itself; a
pair of nodes is dropped when the bits they share, or their sizes, cannot reach the least overlap. Groups of more
than BLOCK_TOKENS shingles are cut into blocks by size, and pairs of blocks are traversed in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stowage.llm.graphs import components, lookup
from stowage.llm.words import mixed, salt, shingle_set
from stowage.operators.scale import fits_broadcast, running_total
from stowage.session import materialize

#: Two sets link when LEVEL[1] * intersection >= LEVEL[0] * union.
LEVEL = (90, 100)
#: Sizes of one band lie within this factor, and share a number of ranges.
BAND = 1.3
#: Shingles of one block of a group.
BLOCK_TOKENS = 1 << 22
#: Children of a node, and bits and words of bitmaps held or compared at once.
FAN, BITMAP_BITS, COMPARED_WORDS = 4, 1 << 29, 1 << 21


@dataclass
class Bands:
    """Where bands of sizes begin, and the ranges a set of a band is cut into."""

    level: tuple[int, int] = LEVEL
    begins: list[int] = field(default_factory=lambda: [1])
    parts: list[int] = field(default_factory=list)
    edges: dict[int, np.ndarray] = field(default_factory=dict)

    def reach(self, size: int) -> None:
        num, den = self.level
        while self.begins[-1] <= size:
            first = self.begins[-1]
            after = max(first + 1, int(first * BAND))
            # The most that a set of the band and a larger partner can differ by.
            small = after - 1
            large = small * den // num
            least = -(-num * (small + large) // (num + den))
            self.parts.append(max(1, small + large - 2 * least + 1))
            self.begins.append(after)

    def bands_of(self, size: int) -> list[int]:
        """The band of a size, and the one below if a smaller partner can lie there."""
        self.reach(size)
        band = int(np.searchsorted(self.begins, size, "right")) - 1
        smallest = -(-size * self.level[0] // self.level[1])
        return [band] if smallest >= self.begins[band] or not band else [band, band - 1]

    def cuts(self, parts: int) -> np.ndarray:
        if parts not in self.edges:
            self.edges[parts] = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        return self.edges[parts]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each range of each band the set is filed under."""
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mixed(shingles ^ salt(7)), out=sums[1:])
        out = []
        for band in self.bands_of(len(shingles)):
            parts = self.parts[band]
            at = np.r_[0, np.searchsorted(shingles, self.cuts(parts)), len(shingles)]
            place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
            out.append(mixed(sums[at[1:]] - sums[at[:-1]] + mixed(place + salt(3))))
        return np.concatenate(out)


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    if not len(shingles):
        return 0, 0
    both = [mixed(shingles ^ salt(n)).sum(dtype=np.uint64, keepdims=True) for n in (11, 13)]
    return tuple(int(mixed(b + np.uint64(len(shingles))).view(np.int64)[0]) for b in both)


MEASURED = pa.schema([
    ("id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
    ("keys", pa.list_(pa.int64())),
])
MEASURED_DDL = "id bigint, place bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>"


def _measure(level: tuple[int, int], words: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(level)
        for batch in batches:
            rows = []
            keys = []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py().encode(), words)
                rows.append((len(shingles), *identity(shingles)))
                keys.append(bands.keys(shingles).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
            n, c1, c2 = (pa.array(c, pa.int64()) for c in zip(*rows)) if rows else [pa.array([], pa.int64())] * 3
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            filed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, c1, c2, filed], schema=MEASURED
            )

    return measure


CHAIN_DDL = "part int, place int, key bigint, n bigint, a bigint, b bigint"
CHAIN = pa.schema([
    ("part", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("n", pa.int64()),
    ("a", pa.int64()), ("b", pa.int64()),
])


def _chain(level: tuple[int, int]):
    """Rows (key, n, c) in order to links of neighbours; the first (place 0) and last row (place 2) of a task go along."""
    num, den = level

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def rows(place: int, key, n, a, b) -> pa.RecordBatch:
            columns = [np.full(len(a), part, np.int32), np.full(len(a), place, np.int32), key, n, a, b]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=CHAIN)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, c = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                yield rows(0, key[:1], n[:1], c[:1], c[:1])
            else:
                key, n, c = (np.r_[x, y] for x, y in zip(last, (key, n, c)))
            same = (key[1:] == key[:-1]) & (n[1:] * num <= n[:-1] * den) & (c[1:] != c[:-1])
            pairs = np.unique(np.stack([c[:-1][same], c[1:][same]], axis=1), axis=0)
            if len(pairs):
                zero = np.zeros(len(pairs), np.int64)
                yield rows(1, zero, zero, pairs[:, 0].copy(), pairs[:, 1].copy())
            last = key[-1:], n[-1:], c[-1:]
        if last is not None:
            yield rows(2, *last, last[2])

    return chain


def coarse_links(keyed: DataFrame, level: tuple[int, int] = LEVEL) -> DataFrame:
    """Links (a, b) that join all sets with a common key and sizes that can match.

    The rows (key, n, c1) are dealt out by ranges of all three, so a crowded key spans many tasks. Neighbours are
    linked; what a border between tasks parts is linked from the first and last row of each task.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "n", "c1"]
    sorted_rows = keyed.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(sorted_rows.mapInArrow(_chain(level), CHAIN_DDL), "chain")
    borders = sorted(map(tuple, found.where("place <> 1").select("part", "place", "key", "n", "a").collect()))
    num, den = level
    across = [
        (x[4], y[4]) for x, y in zip(borders, borders[1:])  # the last row of a task and the next one's first
        if x[0] != y[0] and x[2] == y[2] and y[3] * num <= x[3] * den and x[4] != y[4]
    ]
    links = found.where("place = 1").select("a", "b")
    return links.unionByName(spark.createDataFrame(across, "a bigint, b bigint")) if across else links


# --- Signature trees -----------------------------------------------------------


@dataclass
class Level:
    """Nodes of one level: OR of bitmaps, range of sizes, most shingles that share a bit with others, labels."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    excess: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray

    def above(self) -> Level:
        """The parents of FAN neighbours each."""
        at = np.arange(0, len(self.low), FAN)
        fold = {"low": np.minimum, "high": np.maximum, "excess": np.maximum, "label_low": np.minimum,
                "label_high": np.maximum}
        folded = {name: f.reduceat(getattr(self, name), at) for name, f in fold.items()}
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), **folded)


def tree_of(leaves: Level) -> list[Level]:
    levels = [leaves]
    while len(levels[-1].low) > FAN:
        levels.append(levels[-1].above())
    return levels


def leaves_of(sets: list[np.ndarray], labels: np.ndarray) -> tuple[Level, bool]:
    """Bitmaps over the shingles that several sets hold, and whether every such shingle has a bit of its own."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    dense = (np.cumsum(shared) - 1)[number]
    kept = shared[number]
    dense, owner = dense[kept], owner[kept]
    wanted = max(1, int(shared.sum()))
    words = max(1, min(-(-wanted // 64), BITMAP_BITS // 64 // len(sets)))
    whole = wanted <= 64 * words
    dense = dense % (64 * words)
    bits = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(bits, (owner, dense >> 6), np.uint64(1) << (dense & 63).astype(np.uint64))
    held = np.bincount(owner, minlength=len(sets))
    excess = held - np.bitwise_count(bits).sum(1, dtype=np.int64)
    return Level(bits, sizes, sizes, excess, labels, labels), whole


class Forest:
    """Which sets are known to be connected."""

    def __init__(self, labels: np.ndarray):
        _, self.root = np.unique(labels, return_inverse=True)
        first = np.full(len(labels), len(labels), np.int64)
        np.minimum.at(first, self.root, np.arange(len(labels)))
        self.root = first[self.root].tolist()

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def roots(self) -> np.ndarray:
        root = np.array(self.root)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        return root

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j


def traverse(left: list[Level], right: list[Level] | None, level: tuple[int, int]) -> Iterator[tuple]:
    """Pairs of leaves (i, j, overlap bound) that the trees cannot rule out; a tree against itself if `right` is None."""
    num, den = level
    other = left if right is None else right
    depth = max(len(left), len(other)) - 1

    def at(tree: list[Level], k: int) -> Level:
        return tree[min(k, len(tree) - 1)]

    top_i, top_j = np.meshgrid(np.arange(len(at(left, depth).low)), np.arange(len(at(other, depth).low)), indexing="ij")
    i, j = top_i.ravel(), top_j.ravel()
    if right is None:
        i, j = i[i <= j], j[i <= j]
    stack = [(depth, i, j)]
    while stack:
        k, i, j = stack.pop()
        a, b = at(left, k), at(other, k)
        step = max(1, COMPARED_WORDS // a.bits.shape[1])
        if len(i) > step:
            stack.append((k, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        bound = np.bitwise_count(a.bits[i] & b.bits[j]).sum(1, dtype=np.int64)
        bound += np.minimum(a.excess[i], b.excess[j])
        bound = np.minimum(bound, np.minimum(a.high[i], b.high[j]))
        fits = (num + den) * bound >= num * (a.low[i] + b.low[j])
        fits &= (a.high[i] * den >= num * b.low[j]) & (b.high[j] * den >= num * a.low[i])
        one = (a.label_low[i] == a.label_high[i]) & (b.label_low[j] == b.label_high[j])
        fits &= ~(one & (a.label_low[i] == b.label_low[j]))
        i, j, bound = i[fits], j[fits], bound[fits]
        if not k:
            if len(i):
                yield i, j, bound
            continue
        if not len(i):
            continue
        # A tree that is not as deep as the other stays at its top until the other has come down to it.
        fan_i = FAN if k < len(left) else 1
        fan_j = FAN if k < len(other) else 1
        child = [(x, y) for x in range(fan_i) for y in range(fan_j)]
        i = (i[:, None] * fan_i + np.array([x for x, _ in child])).ravel()
        j = (j[:, None] * fan_j + np.array([y for _, y in child])).ravel()
        inside = (i < len(at(left, k - 1).low)) & (j < len(at(other, k - 1).low))
        if right is None:
            inside &= i <= j
        stack.append((k - 1, i[inside], j[inside]))


def tree_links(
    sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, level: tuple[int, int] = LEVEL
) -> list[tuple[int, int]]:
    """Links that join all sets of one group connected at the level, beside what `labels` says already.

    `sides` is 0 and 1 for two blocks that are compared with each other only, else all 0.
    """
    num, den = level
    # Similar sets share their smallest shingles, so this order brings them under one node.
    smallest = np.array([(s[0], s[min(1, len(s) - 1)]) for s in sets])
    order = np.lexsort((smallest[:, 1], smallest[:, 0], sides))
    sets, labels, sides = [sets[i] for i in order], labels[order], sides[order]
    leaves, whole = leaves_of(sets, labels)
    first = int((sides == 0).sum())

    def cut(low: int, high: int) -> list[Level]:
        return tree_of(Level(*(getattr(leaves, f)[low:high] for f in Level.__dataclass_fields__)))

    left, right = cut(0, first), cut(first, len(sets)) if first < len(sets) else None
    forest, links = Forest(labels), []
    for i, j, bound in traverse(left, right, level):
        j = j + first if right is not None else j
        while len(i):
            root = forest.roots()
            apart = root[i] != root[j]
            i, j, bound = i[apart], j[apart], bound[apart]
            # A few at a time: what they link is not looked at again.
            for a, b, overlap in zip(i[:4096].tolist(), j[:4096].tolist(), bound[:4096].tolist()):
                if forest.find(a) == forest.find(b):
                    continue
                if not whole:
                    overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if (num + den) * overlap >= num * (len(sets[a]) + len(sets[b])) and forest.join(a, b):
                    links.append((int(order[a]), int(order[b])))
            i, j, bound = i[4096:], j[4096:], bound[4096:]
    return links


SETS = pa.schema([
    ("grp", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
    ("shingles", pa.binary()),
])
SETS_DDL = "grp bigint, block bigint, n bigint, c1 bigint, c2 bigint, shingles binary"
LINKS_DDL = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"
LINKS = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])


def _hold(words: int):
    """Rows (group, block, text) to the sets of their texts."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, block, text in zip(*(batch.column(i) for i in range(3))):
                shingles = shingle_set(text.as_py().encode(), words)
                rows.append((group.as_py(), block.as_py(), len(shingles), *identity(shingles), shingles.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), SETS)], schema=SETS
                )

    return hold


def _compare(level: tuple[int, int]):
    """Rows (grp, i, j, side, label, c1, c2, shingles) in order of the first three to links; one group is held at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def links() -> pa.RecordBatch:
            found = []
            if len(held) > 1:
                sets = [np.frombuffer(r[4], np.uint64) for r in held]
                labels = np.array([r[1] for r in held], np.int64)
                sides = np.array([r[0] for r in held], np.int64)
                pairs = tree_links(sets, labels, sides, level)
                found = [(*held[a][2:4], *held[b][2:4]) for a, b in pairs]
            columns = zip(*found) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=LINKS)

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            rows = zip(*(batch.column(i).to_pylist() for i in range(3, 8)))
            for key, row in zip(keys, rows):
                if key != now:
                    yield links()
                    held, now = [], key
                held.append(row)
        yield links()

    return compare


def _compared(sets: DataFrame, pairs: DataFrame, labels: DataFrame | None, level: tuple[int, int]) -> DataFrame:
    """Links between the sets of pairs of blocks (grp, i, j, i <= j)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = F.array_distinct(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")),
                                     F.struct(F.col("j").alias("block"), (F.col("i") < F.col("j")).cast("int").alias("side"))))
    places = pairs.select("grp", "i", "j", F.explode(sides).alias("s")).select("grp", "i", "j", "s.*")
    rows = sets.withColumn("label", F.xxhash64("c1", "c2")) if labels is None else (
        sets.join(labels, ["c1", "c2"], "left")
        .withColumn("label", F.coalesce("label", F.xxhash64("c1", "c2")))
    )
    keys = ["grp", "i", "j"]
    dealt = rows.join(places, ["grp", "block"]).select(*keys, "side", "label", "c1", "c2", "shingles")
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "side")
    return materialize(dealt.mapInArrow(_compare(level), LINKS_DDL), "links")


def _labels(links: DataFrame) -> DataFrame:
    """(c1, c2, label) of all linked sets."""
    edges = links.select(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("a"),
                         F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b"))
    return components(edges).select("node.c1", "node.c2", F.xxhash64("label.c1", "label.c2").alias("label"))


def group_links(sets: DataFrame, level: tuple[int, int] = LEVEL) -> DataFrame:
    """Links among the stored sets of each group, a block pair a task.

    Blocks are first compared with themselves, then with the first block of their group; what
    that has connected is one label, and pairs of blocks of one label are not compared again.
    """
    blocks = materialize(
        sets.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "blocks"
    )
    alone = blocks.select("grp", F.col("block").alias("i"), F.col("block").alias("j"))
    links = _compared(sets, alone, None, level)
    if blocks.where("block > 0").isEmpty():
        return links
    num, den = level
    left = blocks.select("grp", F.col("block").alias("i"), F.col("high").alias("_high"))
    right = blocks.select("grp", F.col("block").alias("j"), "low")
    pairs = left.join(right, "grp").where((F.col("i") < F.col("j")) & (F.col("_high") * den >= F.col("low") * num))
    pairs = materialize(pairs.select("grp", "i", "j"), "pairs")
    links = links.unionByName(_compared(sets, pairs.where("i = 0"), materialize(_labels(links), "labels"), level))
    labels = materialize(_labels(links), "labels")
    known = sets.select("grp", "block", "c1", "c2").join(labels, ["c1", "c2"], "left").groupBy("grp", "block").agg(
        F.min(F.coalesce("label", F.xxhash64("c1", "c2"))).alias("low"),
        F.max(F.coalesce("label", F.xxhash64("c1", "c2"))).alias("high"),
    )
    known = materialize(known.select("grp", "block", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one")), "known")
    of_i = known.select("grp", F.col("block").alias("i"), F.col("one").alias("_i"))
    of_j = known.select("grp", F.col("block").alias("j"), F.col("one").alias("_j"))
    rest = pairs.where("i > 0").join(of_i, ["grp", "i"]).join(of_j, ["grp", "j"])
    rest = rest.where("_i IS NULL OR _j IS NULL OR _i <> _j").select("grp", "i", "j")
    return links.unionByName(_compared(sets, rest, labels, level))


def jaccard_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3,
    level: tuple[int, int] = LEVEL,
) -> DataFrame:
    """id, n_shingles and component_id (smallest id it is connected with) of each row, one row per input row.

    A-Z are lower-cased. Two rows link when level[1] * intersection >= level[0] * union of their distinct shingles.
    Null and empty texts have no shingles and are linked with nothing, not even their like: their component is their
    own id. Null ids get a component but never name one; a component of null ids only is null.
    Repeated rows stay repeated; ids that occur several times are one document as far as component_id goes.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("place"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    of_docs = materialize(rows.mapInArrow(_measure(level, words), MEASURED_DDL), "shingles")
    classes = materialize(
        of_docs.where("n > 0").groupBy("c1", "c2").agg(
            F.min(F.struct("id", "place")).alias("rep"), F.min("id").alias("first"),
            F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("keys").alias("keys"),
        ),
        "classes",
    )
    keyed = classes.select(F.explode("keys").alias("key"), "n", "c1")
    coarse = materialize(components(coarse_links(keyed, level)), "coarse")
    members = materialize(
        classes.select("rep", "n", "c1", "c2").join(coarse, F.col("c1") == F.col("node"))
        .select(F.col("label").alias("grp"), "rep", "n", "c1", "c2"),
        "members",
    )
    large = members.groupBy("grp").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > BLOCK_TOKENS).select("grp")
    large = materialize(large, "large")
    blocked = members.join(large, "grp", "left_anti").withColumn("block", F.lit(0).cast("bigint"))
    if not large.isEmpty():
        cut = running_total(members.join(large, "grp"), ["grp"], ["n", "c1", "c2"], F.col("n"), "upto")
        blocked = blocked.unionByName(
            cut.withColumn("block", ((F.col("upto") - 1) / BLOCK_TOKENS).cast("bigint")).drop("upto")
        )
    wanted = materialize(blocked.select("grp", "block", "rep.*"), "wanted")
    wanted = wanted.withColumnsRenamed({"id": "_id", "place": "_place"})
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")))
    held = texts.select("grp", "block", "text").mapInArrow(_hold(words), SETS_DDL)
    names = [c for c in held.columns if c != "shingles"]
    sets = materialize(held.groupBy(*names).agg(F.first("shingles").alias("shingles")), "sets")
    links = group_links(sets, level)
    smallest = _labels(links).join(classes.select("c1", "c2", "first"), ["c1", "c2"])
    of_label = smallest.groupBy("label").agg(F.min("first").alias("component_id"))
    moved = smallest.join(of_label, "label").select("c1", "c2", "component_id")
    named = classes.select("c1", "c2", "first", "copies").join(moved, ["c1", "c2"], "left").select(
        "c1", "c2", "copies", F.coalesce("component_id", "first").alias("component_id")
    )
    filled = of_docs.where("n > 0").select("id", "n", "c1", "c2")
    found = lookup(filled, materialize(named, "named"), ["c1", "c2"], "copies").select("id", "n", "component_id")
    found = found.unionByName(of_docs.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


#: The same rows in SQL: pairs of documents by their common shingles, and their closure.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b
  ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM sets
"""
