"""64-bit hashes of the words of texts, worked out on whole arrays of bytes.

A word's hash is a polynomial of its bytes. Running sums of `table[byte] * BASE ** place` over a piece of the
text give it for all words at once: the difference between a word's two ends, divided by the power at its
beginning. Texts are worked on in pieces of CHUNK bytes, so the memory needed is that of a piece, however long
a text or a word is; a word across a border is carried on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19
WRAP = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(number: int) -> np.uint64:
    return mixed(np.array([(number + 1) * BASE & WRAP], np.uint64))[0]


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & WRAP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


FORWARD, BACKWARD = powers(BASE, CHUNK + 1), powers(pow(BASE, -1, 1 << 64), CHUNK + 1)


@dataclass
class Words:
    """Begin, end (bytes, end exclusive) and hash of each word in order."""

    begin: np.ndarray
    end: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.value)


def separators(signs: bytes) -> np.ndarray:
    """Table by byte: whether it separates words."""
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


SPACES = separators(b" \t\n\v\f\r")


def hashed_words(data: bytes, between: np.ndarray = SPACES) -> Words:
    """The words of a text; A to Z have to be lower-cased before."""
    begins, ends, values = [], [], []
    open_at, open_length, open_value = -1, 0, 0
    for low in range(0, len(data), CHUNK):
        piece = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - low), low)
        apart = between[piece]
        edge = np.flatnonzero(np.diff(np.r_[True, apart, True].view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTES[piece] * FORWARD[: len(piece)], out=sums[1:])
        value = (sums[end] - sums[begin]) * BACKWARD[begin]
        begin, end = begin + low, end + low
        if open_at >= 0:
            if len(begin) and begin[0] == low:  # the open word goes on
                more = int(value[0]) * pow(BASE, open_length, 1 << 64)
                value[0] = np.uint64((open_value + more) & WRAP)
                begin[0] = open_at
            else:
                begin, end = np.r_[open_at, begin], np.r_[low, end]
                value = np.r_[np.uint64(open_value), value]
        open_at = -1
        if len(end) and end[-1] == low + len(piece) < len(data):
            open_at, open_length = int(begin[-1]), int(end[-1] - begin[-1])
            open_value = int(value[-1])
            begin, end, value = begin[:-1], end[:-1], value[:-1]
        begins.append(begin)
        ends.append(end)
        values.append(value)
    if not begins:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64))
    begin, end = np.concatenate(begins), np.concatenate(ends)
    lengths = (end - begin).astype(np.uint64)
    return Words(begin, end, mixed(np.concatenate(values) + lengths * np.uint64(BASE)))


def shingle_set(text: bytes, words: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence; empty without."""
    value = hashed_words(text.lower()).value
    n = min(words, len(value))
    if not n:
        return value
    joined = np.full(len(value) - n + 1, salt(n))
    for i in range(n):
        joined = mixed(joined + value[i : len(value) - n + 1 + i])
    return np.unique(joined)
