"""Token counts of a sentencepiece BPE model by rank-synchronous array merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: Chunks are cut where letters end if no piece of the model joins them to anything else.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"
NO_PAIR = np.int32(2**31 - 1)
#: Chunks whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
#: Chunks merged in one set of arrays.
AT_ONCE = 65_536
#: Symbols from which a chunk is merged by itself, touching only the places whose pairs changed.
LONG = 1024


class PieceModel:
    """Symbols, pair table and cut points of a model file.

    A symbol is a string that can occur while merging: a piece or one character of
    a piece. The pair table maps two neighbouring symbols to the piece they form;
    its rank is the place of the piece's score, so equal scores share a rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        pieces = {
            model.id_to_piece(i): model.get_score(i)
            for i in numbers
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        if any(model.is_unused(i) for i in numbers) or not any(model.is_byte(i) for i in numbers):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        for probe in ("", " a  b ", "　x\tﬁ"):
            plain = SPACE + probe.replace(" ", SPACE) if probe else ""
            if model.normalize(probe) != plain:
                raise ValueError("only models that leave the text as it is are supported")
        self._symbols(pieces)
        self._pairs(pieces)
        self._cuts(pieces)

    def _symbols(self, pieces: dict[str, float]) -> None:
        characters = sorted({c for piece in pieces for c in piece})
        self.names = characters + sorted(p for p in pieces if len(p) > 1)
        self.number = {name: i for i, name in enumerate(self.names)}
        self.of_character = np.full(0x110000, -1, np.int32)
        for c in characters:
            self.of_character[ord(c)] = self.number[c]
        # What a symbol costs when it survives: one token, or its bytes when it is no piece.
        self.cost = np.array([1 if n in pieces else len(n.encode()) for n in self.names], np.int64)

    def _pairs(self, pieces: dict[str, float]) -> None:
        place = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        size = len(self.names)
        keys, ranks, merged = [], [], []
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    ranks.append(place[score])
                    merged.append(self.number[piece])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.merged = np.array(merged, np.int32)[order]
        # A piece that could take part in a pair of its own or a better rank has to be
        # merged one occurrence at a time; of all others every occurrence goes at once.
        own = np.full(size, NO_PAIR, np.int32)
        own[self.merged] = self.ranks
        self.careful = np.zeros(size, bool)
        for part in (self.keys // size, self.keys % size):
            np.logical_or.at(self.careful, part[self.ranks <= own[part]], True)
        self.careful &= own != NO_PAIR
        self.size = size
        self.rows = {key: row for row, key in enumerate(self.keys.tolist())}

    def _cuts(self, pieces: dict[str, float]) -> None:
        """Places no piece reaches across: the merges on either side are independent."""
        inner = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.words = not any(b[1] == SPACE != b[0] for b in inner)
        joined = {c for b in inner for c in b}
        alone = "".join(c for c in "\t\n\r\v\f" if c not in joined)
        other = f"[^{SPACE}{re.escape(alone)}]+"
        tail = f"|[{re.escape(alone)}]" if alone else ""
        is_letter = re.compile(LETTERS).fullmatch
        across = [b for b in inner if SPACE not in b and bool(is_letter(b[0])) != bool(is_letter(b[1]))]
        if not across:
            other = f"(?:{LETTERS}+|[^{SPACE}{re.escape(alone)}{LETTERS[1:-1]}]+)"
        self.chunk = re.compile(f"{SPACE}*{other}{tail}|{SPACE}+").findall

    def chunks(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        return self.chunk(marked) if self.words else [marked][: len(marked)]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the pair table for each pair of neighbours, -1 where they do not merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk.

        The symbols of all chunks stand in one array, with the sequence they belong
        to. A round finds the lowest rank of each sequence, merges the pairs that have
        it from the left, and closes the gaps. Sequences without a pair leave.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbol = self.of_character[points]
        sequence = np.repeat(np.arange(len(chunks)), lengths)
        total = np.zeros(len(chunks), np.int64)
        # Characters the model lacks are written as their bytes and never merge.
        lacking = symbol < 0
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        total += np.bincount(
            sequence[lacking], width[lacking], minlength=len(chunks)
        ).astype(np.int64)

        def pairs_of(symbol: np.ndarray, sequence: np.ndarray) -> np.ndarray:
            found = np.full(len(symbol), -1, np.int64)
            near = np.flatnonzero(sequence[:-1] == sequence[1:])
            found[near] = self.lookup(symbol[near], symbol[near + 1])
            return found

        pair = pairs_of(symbol, sequence) if len(symbol) else np.zeros(0, np.int64)
        while len(symbol):
            rank = np.where(pair >= 0, self.ranks[pair], NO_PAIR)
            first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            size = np.diff(np.r_[first, len(symbol)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), size)
            going = lowest != NO_PAIR
            if not going.all():
                done = ~going & (symbol >= 0)
                total += np.bincount(
                    sequence[done], self.cost[symbol[done]], minlength=len(chunks)
                ).astype(np.int64)
                symbol, sequence, pair = symbol[going], sequence[going], pair[going]
                rank, lowest = rank[going], lowest[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            # Of pairs that overlap, the first, third, ... of each run of neighbours merge.
            starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            since = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            at = at[since % 2 == 0]
            careful = self.careful[self.merged[pair[at]]]
            if careful.any():
                leading = np.r_[True, sequence[at][1:] != sequence[at][:-1]]
                slow = np.zeros(len(total), bool)
                slow[sequence[at][careful]] = True
                at = at[leading | ~slow[sequence[at]]]
            symbol[at] = self.merged[pair[at]]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            symbol, sequence, pair, changed = (
                symbol[kept], sequence[kept], pair[kept], changed[kept]
            )
            # The symbol before a merge may have been swallowed by another one just now.
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            near = again[again < len(symbol) - 1]
            near = near[sequence[near] == sequence[near + 1]]
            pair[again] = -1
            pair[near] = self.lookup(symbol[near], symbol[near + 1])
        return total

    def merge_long(self, chunk: str) -> int:
        """Tokens of one long chunk.

        Pairs wait in buckets by rank. A round takes the lowest bucket, merges all its pairs from the left
        and looks again only at the pairs beside them, so a chunk costs what its merges cost.
        """
        points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        symbol = self.of_character[points].astype(np.int64)
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n + 1, -1, np.int64)  # of each symbol with the next; the last place stands for none
        pair[: n - 1] = self.lookup(symbol[:-1], symbol[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[pair[at] >= 0]
            if len(at):
                rank = self.ranks[pair[at]]
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(np.diff(rank)) + 1
                for number, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                    if number not in waiting:
                        waiting[number] = []
                        heapq.heappush(ranks, number)
                    waiting[number].append(some)

        alive = np.ones(n, bool)
        wait(np.arange(n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[(pair[at] >= 0) & (self.ranks[pair[at]] == rank)]
            if not len(at):
                continue
            if self.careful[self.merged[pair[at]]].any():
                wait(self._one_by_one(rank, at, symbol, after, before, pair, alive))
                continue
            # Of pairs that overlap, the first, third, ... of each run of neighbours merge.
            starts = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            since = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            at = at[since % 2 == 0]
            right = after[at]
            symbol[at] = self.merged[pair[at]]
            alive[right], pair[right] = False, -1
            after[at] = after[right]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            again = np.unique(np.r_[at, before[at]])
            again = again[again >= 0]
            last = again[after[again] >= n]
            again = again[after[again] < n]
            pair[last] = -1
            pair[again] = self.lookup(symbol[again], symbol[after[again]])
            wait(again)
        left = symbol[alive]
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        return int(self.cost[left[left >= 0]].sum() + width[self.of_character[points] < 0].sum())

    def _one_by_one(self, rank: int, at: np.ndarray, symbol, after, before, pair, alive) -> np.ndarray:
        """Merge the pairs of one rank from the left, and at once any of a better or equal rank that this forms.

        Returns the places whose pairs of worse ranks have to wait again.
        """
        n, later = len(symbol), []
        due = [(rank, int(i)) for i in at]  # sorted, so a heap
        while due:
            now, i = heapq.heappop(due)
            row = int(pair[i])
            if row < 0 or self.ranks[row] != now:
                continue
            right = int(after[i])
            symbol[i] = self.merged[row]
            alive[right], pair[right] = False, -1
            far = int(after[right])
            after[i] = far
            if far < n:
                before[far] = i
            for j in (int(before[i]), i):
                if j < 0:
                    continue
                k = int(after[j])
                found = self.rows.get(int(symbol[j]) * self.size + int(symbol[k]), -1) if k < n and symbol[j] >= 0 and symbol[k] >= 0 else -1
                pair[j] = found
                if found >= 0:
                    if self.ranks[found] <= rank:
                        heapq.heappush(due, (int(self.ranks[found]), j))
                    else:
                        later.append(j)
        return np.unique(np.array(later, np.int64))

    def count(self, texts: list[str], known: dict[str, int]) -> list[int]:
        """Tokens of each text; `known` remembers chunks from earlier calls."""
        cut = [self.chunks(text) for text in texts]
        new: dict[str, None] = {}
        for chunks in cut:
            new.update(dict.fromkeys(c for c in set(chunks) if len(c) < LONG and c not in known))
        fresh = list(new)
        for i in range(0, len(fresh), AT_ONCE):
            some = fresh[i : i + AT_ONCE]
            known.update(zip(some, self.merge(some).tolist()))
        out = [
            sum(known[c] if len(c) < LONG else self.merge_long(c) for c in chunks) for chunks in cut
        ]
        if len(known) > REMEMBERED:
            known.clear()
        return out


def blocks_of(texts: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive texts of about `size` characters together, at least one at a time."""
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 4096,
    block: int = 2_000_000,
) -> DataFrame:
    """Bytes and tokens of each whole text, one row per input row, as the model's library counts.

    A null text counts as empty; empty texts have no tokens. Texts are worked on in
    blocks of about `block` characters, a longer one by itself. Repeated rows stay
    repeated, null ids stay null, further columns are left out.
    """

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = PieceModel(model_path), {}
        for batch in batches:
            counts: list[int] = []
            for texts in blocks_of(batch.tolist(), block):
                counts += model.count(texts, known)
            yield pd.Series(counts, dtype="int64")

    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
