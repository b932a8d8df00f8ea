"""Words of texts, and 64-bit hashes of words and word windows, computed on whole Arrow buffers.

A word is a run of bytes outside 20 and 09 to 0D (hexadecimal). Its hash adds up a mixed value of each eight bytes and
their place, and mixes the sum with the length; a window's hash joins the hashes of its halves by a mixing that isn't
linear. Both are the same on every machine and wherever in a buffer the words lie. One such hash picks candidates and
stands for an n-gram within one pair of sets; what is taken as equal without a look at the bytes has two of them, of
different seeds from the bytes on (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kindred.llm.shared import forget

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Bytes below 80 (hexadecimal) that are neither letters nor digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The low 0 to 8 bytes of an integer.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: An odd factor that leaves 2 modulo 4 when one is taken off, so that swapped halves differ.
_LEFT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the published splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """One hash function of many; lower folds A-Z."""

    def __init__(self, seed: int, lower: bool = False) -> None:
        self.seed, self.lower = mix(np.array([seed], np.uint64) * _STEP + np.uint64(1))[0], lower

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash per run of one byte or more given by its place in the buffer."""
        if not len(start):
            return np.empty(0, np.uint64)
        room = np.zeros(len(data) + 8, np.uint8)
        room[: len(data)] = LOWER[data] if self.lower else data
        eight = np.ndarray((len(data) + 1,), "<u8", room, 0, (1,))
        size = end - start
        total = mix(eight[start] & _LOW[np.minimum(size, 8)] ^ mix(np.array([self.seed]))[0])
        more = np.flatnonzero(size > 8)
        if len(more):
            count = (size[more] - 1) >> 3
            first = np.cumsum(count) - count
            nth = np.arange(1, int(count.sum()) + 1) - np.repeat(first, count)
            value = eight[np.repeat(start[more], count) + 8 * nth] & _LOW[np.minimum(np.repeat(size[more], count) - 8 * nth, 8)]
            total[more] += np.add.reduceat(mix(value ^ mix(nth.astype(np.uint64) * _STEP + self.seed)), first)
        return mix(total + size.astype(np.uint64) * _LEFT)

    def windows(self, h: np.ndarray, width: int) -> np.ndarray:
        """A hash per run of width consecutive word hashes."""
        if len(h) < width:
            return np.empty(0, np.uint64)
        join = lambda a, b: mix(a * _LEFT + (b ^ self.seed))
        size = 1
        while 2 * size <= width:
            h = join(h[:-size], h[size:])
            size *= 2
        if width > size:
            h = join(h[: len(h) - (width - size)], h[width - size :])
        return mix(h + np.uint64(width))


def argmin(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each run of width values, the first of several."""
    at, size = np.arange(len(x)), 1

    def less(k: int) -> None:
        nonlocal x, at
        n = len(x) - k
        right = x[k:] < x[:n]
        x, at = np.where(right, x[k:], x[:n]), np.where(right, at[k:], at[:n])

    while 2 * size <= width and len(x) > size:
        less(size)
        size *= 2
    if width > size:
        less(min(width - size, len(x)))
    return at


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying its data; null is empty."""
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def split(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): places of all words in the buffer, and per text the index of its first word (and the total).

    outside: the bytes that part words."""
    word = ~outside[data]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < len(data))]
    edge = np.zeros(len(data) + 1, bool)
    edge[[0, -1]] = True
    edge[at] = True
    before = np.concatenate([[False], word]) & ~edge  # a word goes on from the byte before
    start = np.flatnonzero(word & ~before[:-1])
    end = np.flatnonzero(word & ~(np.concatenate([word[1:], [False]]) & ~edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def parts(batches: Iterator[pa.RecordBatch], text: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of whole rows with about `size` bytes of text each."""
    forget()
    for b in batches:
        if not b.num_rows:
            continue
        _, off = buffers(b.column(text))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
