"""Reader for files made by the Unix ``compress`` program (``.Z``)."""

from __future__ import annotations

import io
from typing import BinaryIO

MAGIC = b"\x1f\x9d"
CLEAR = 256
FIRST_BITS = 9


class _Decoder(io.RawIOBase):
    """Decodes while it is read; the table of strings is the only state kept."""

    def __init__(self, source: BinaryIO):
        header = source.read(3)
        if header[:2] != MAGIC or len(header) < 3:
            raise ValueError("not a .Z file")
        self._source = source
        self._max_bits = header[2] & 0x1F
        if not FIRST_BITS <= self._max_bits <= 16:
            raise ValueError("unsupported code width in .Z file")
        self._has_clear = bool(header[2] & 0x80)
        self._pending = bytearray()
        self._codes: list[int] = []
        self._bits = FIRST_BITS
        self._previous: bytes | None = None
        self._reset()

    def _reset(self) -> None:
        self._strings = [bytes([i]) for i in range(256)]
        if self._has_clear:
            self._strings.append(b"")
        self._bits = FIRST_BITS
        self._previous = None

    def _next_code(self) -> int | None:
        # codes come in groups of eight of the same width; the rest of a group is
        # dropped when the width changes
        if not self._codes:
            group = self._source.read(self._bits)
            packed = int.from_bytes(group, "little")
            count = len(group) * 8 // self._bits
            mask = (1 << self._bits) - 1
            self._codes = [(packed >> (i * self._bits)) & mask for i in range(count)][::-1]
        return self._codes.pop() if self._codes else None

    def _step(self) -> bool:
        """Decode one code; False at the end."""
        code = self._next_code()
        if code is None:
            return False
        if code == CLEAR and self._has_clear:
            self._reset()
            self._codes = []
            return True
        if code < len(self._strings):
            text = self._strings[code]
        elif code == len(self._strings) and self._previous:
            text = self._previous + self._previous[:1]
        else:
            raise ValueError("damaged .Z file")
        if self._previous is not None and len(self._strings) < 1 << self._max_bits:
            self._strings.append(self._previous + text[:1])
            if len(self._strings) == 1 << self._bits and self._bits < self._max_bits:
                self._bits += 1
                self._codes = []
        self._previous = text
        self._pending += text
        return True

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while len(self._pending) < len(buffer) and self._step():
            pass
        count = min(len(buffer), len(self._pending))
        buffer[:count] = self._pending[:count]
        del self._pending[:count]
        return count


def open_lzw(source: BinaryIO) -> io.BufferedReader:
    return io.BufferedReader(_Decoder(source))
