"""Vector work on the UTF-8 bytes of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


#: A random 64-bit value for each byte, from the scramble itself.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)

#: The byte itself, with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(bytes_in: bytes) -> np.ndarray:
    """True for the given bytes."""
    t = np.zeros(256, bool)
    t[np.frombuffer(bytes_in, np.uint8)] = True
    return t


#: Space and the controls from tab to carriage return.
SPACE = table_of(b" \t\n\x0b\x0c\r")


def _plain(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The column without nulls, and the offsets of its rows and of its end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    return column, np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)


def _runs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def runs(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of about `size` bytes of text; a longer text is a run of its own."""
    return _runs(_plain(column)[1], size)


def pieces(column: pa.Array, lower: bool = False, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets of the rows, bytes) of the runs, in lower case if asked. Null texts have no bytes.

    Only the run itself is copied, so what a task holds follows from `size` and its longest text.
    """
    column, ends = _plain(column)
    for i, j in _runs(ends, size):
        part = column.slice(i, j - i)
        part = pc.utf8_lower(part) if lower else part
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + j - i + 1]
        held = part.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        yield i, j, offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        base, found = int(_ODD), []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 2 * PIECE), x, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p))
        if n <= 2 * PIECE:  # those of a single very long text are not kept
            self.up, self.down = found
        return found[0], found[1]


POWERS = Powers()


class Hashed:
    """Hashes of any stretches of some bytes: sums of byte values times powers, moved to the origin."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The stretches' hashes; equal bytes have equal hashes, wherever they stand."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each longest run of bytes that are inside a word, within the rows that offsets mark."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    fresh = np.zeros(n + 1, bool)  # a row begins here, or the bytes end
    fresh[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | fresh[1:n]
    end = inside.copy()  # of the last byte of a word
    end[:-1] &= ~inside[1:] | fresh[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


#: ASCII letters and digits, and every byte of other characters.
_WORDLY = table_of(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))


def in_words(data: np.ndarray) -> np.ndarray:
    """True for bytes of letters, digits and other characters, without general punctuation, no-break spaces and guillemets."""
    inside = _WORDLY[data]
    for lead, second, width in ((0xE2, (0x80,), 3), (0xC2, (0xA0, 0xAB, 0xBB, 0xA1, 0xBF), 2)):
        at = np.flatnonzero(data[:-1] == lead)
        at = at[np.isin(data[at + 1], second)]
        for k in range(width):
            inside[np.minimum(at + k, len(data) - 1)] = False
    return inside
