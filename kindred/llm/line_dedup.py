"""Line deduplication by a segment-partition edit join.

A line is the sequence of its words, and an edit puts in, takes out or changes a word. Of two lines within the allowed
edits, the shorter one is split into one segment more, so one of its segments stands in the longer line whole, moved by
no more than the edits. The segments are indexed under their anchor, the three words of least hash among their first
few; a longer line probes with the anchors of its windows of that many words, so that what a window and an equal segment
are looked up by is the same. Entries meet if the words beside the anchor agree too, and are sifted by length and place; the
lines that remain are compared by a banded bit-parallel edit distance.

Many lines that are near each other meet in all pairs, but the links of a few pairs join them. So a probe that meets many
segments is compared with the first few at first. What it met is looked at again when the classes so far are known: only
pairs of different classes are compared then.

Each candidate line has a sketch: a bit for each of SKETCH classes, set if the line has an odd number of words of that class,
where the second, third and so on of equal words are words of their own. An edit changes two bits at most, and one if it changes the number of words, so sketches of lines within the allowed edits
differ in at most twice as many bits, less the words that one has more; a pair that differs in more is no link, and is left out before any text is fetched. Where a line has so many words that
these bits tell little, a wider sketch with four classes a word or more is compared too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.shared import flagged, left_join_few, left_join_hot, made, shared_dir, stored, swept, text_key
from kindred.llm.words import WHITE, Hasher, argmin, buffers, mix, parts

#: One edit is allowed for so many words of the longer line.
WORDS_AN_EDIT = 10
#: Words of an anchor.
GRAM = 3
#: Segments that a probe is compared with at first.
FEW = 3
#: Bytes of entries that meet at once; larger buckets are cut into blocks, and every two blocks meet.
BLOCK_BYTES = 32 << 20
#: Lines under one anchor that are compared between classes in one task; of more, every two blocks meet.
CELL_ROWS = 8192
#: Bits of a line's sketch, in words of 64.
SKETCH = 256
_LANES = [f"s{k}" for k in range(SKETCH // 64)]
#: Words of a line from which on it has a wider sketch too, and the most bits of that.
WIDE, WIDEST = 32, 1 << 16
_FIRST, _SECOND = Hasher(5), Hasher(6)
_ENTRY = np.dtype([("sig", "<u4"), ("sig2", "u1"), ("id", "<u4"), ("id2", "<u2"), ("size", "<u2"), ("place", "<u2"), ("left", "<u2"), ("right", "<u2"), ("kind", "u1")])
#: Kinds of entries: of a segment that goes on to the left of its anchor, of one that does to the right, and of a window.
LEFT, RIGHT, PROBE = 0, 1, 2
_MOST = 65535
_WORD = re.compile(rb"[\xe0-\xff][\x80-\xbf]*|[^\x20\x09-\x0d\xe0-\xff]+")


def edit_distance(a: Sequence, b: Sequence, most: int) -> int:
    """The Levenshtein distance, or most + 1 if it is larger; a column of the band is one machine word."""
    if len(a) > len(b):
        a, b = b, a
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    # bit i of the band at column j is row j - most + i of the pattern b; rows before 0 count as cheap to enter
    width, where = 2 * most + 1, {}
    full, top = (1 << width) - 1, 1 << 2 * most
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = (full << most) & full, 0, most
    for j, c in enumerate(a):
        eq = where.get(c, 0)
        x = (eq >> (j - most) if j >= most else eq << (most - j)) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        hp, hn = (down | ~(d | up)) & full, d & up
        score += not d & top
        up, down = (hn | ~((d >> 1) | hp)) & full, (d >> 1) & hp
        if score > most + width:
            return most + 1
    # the band's last cell lies at row len(a) + most; walk up to the pattern's last row
    for i in range(2 * most - 1, len(b) - len(a) + most - 1, -1):
        score += bool(down >> i & 1) - bool(up >> i & 1)
    return min(score, most + 1)


def counted(line: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of each word and of how many equal ones its line has before it; so a bag of words becomes a set. Sorted by line."""
    order = np.lexsort((word, line))
    line, word, at = line[order], word[order].astype(np.uint64), np.arange(len(order))
    first = np.append(True, (line[1:] != line[:-1]) | (word[1:] != word[:-1]))[: len(at)]
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(word + mix(nth.astype(np.uint64)))


def parity(word: np.ndarray) -> np.ndarray:
    """The wide sketch of a line of these words, as counted() has them: as the other one, with four or more classes a word."""
    n = min(WIDEST, 64 << ((len(word) - 1) // 16).bit_length())
    classes = (word & np.uint64(n - 1)).astype(np.int64)
    return np.packbits(np.bincount(classes, minlength=n) & 1, bitorder="little").view("<u8")


def differing(sketch: Sequence[np.ndarray | None], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the wide sketches i and j differ, the longer folded to the length of the other; 0 where one is missing."""
    size = np.array([0 if x is None else len(x) for x in sketch], np.int64)
    least, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for n in np.unique(least[least > 0]).tolist():
        some = np.flatnonzero(least == n)
        rows, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
        table = np.stack([np.bitwise_xor.reduce(sketch[r].reshape(-1, n), axis=0) for r in rows.tolist()])
        a, b = at[: len(some)], at[len(some) :]
        step = max(1, (1 << 21) // n)
        for x in range(0, len(some), step):
            out[some[x : x + step]] = np.bitwise_count(table[a[x : x + step]] ^ table[b[x : x + step]]).sum(1, dtype=np.int64)
    return out


#: The most edits whose band is one word of the machine.
BAND = 31


def near_pairs(a: Sequence[bytes], b: Sequence[bytes]) -> np.ndarray:
    """Whether each two lines, of a word or more, are within the edits; pairs with the same edits are compared together, and
    those of many words only if their wide sketches allow it."""
    names: dict[bytes, int] = {}
    line = {x: np.array([names.setdefault(w, len(names)) for w in words(x)], np.int32) for x in {*a, *b}}
    place = {x: k for k, x in enumerate(line)}
    differ = differing([parity(counted(np.zeros(len(x), np.int8), x)) if len(x) >= WIDE else None for x in line.values()], *(np.array([place[x] for x in side], np.int64) for side in (a, b)))
    short, long = [line[x] for x in a], [line[x] for x in b]
    for i, (x, y) in enumerate(zip(short, long)):
        if len(x) > len(y):
            short[i], long[i] = y, x
    n, m = (np.array([len(x) for x in side], np.int64) for side in (short, long))
    most, out = m // WORDS_AN_EDIT, np.zeros(len(n), bool)
    fits = (m - n <= most) & (differ <= 2 * most - (m - n))
    for k in np.unique(most[fits]).tolist():
        some = np.flatnonzero(fits & (most == k))
        if k > BAND:
            out[some] = [edit_distance(short[i].tolist(), long[i].tolist(), k) <= k for i in some]
            continue
        for part in np.split(some, range(1024, len(some), 1024)):
            out[part] = _banded([short[i] for i in part], [long[i] for i in part], n[part], m[part], k) <= k
    return out


def _banded(short: list[np.ndarray], long: list[np.ndarray], n: np.ndarray, m: np.ndarray, most: int) -> np.ndarray:
    """edit_distance of many pairs, column by column of all; n, m: their lengths."""
    width = 2 * most + 1
    a, b = np.full((n.max(), len(n)), -1, np.int32), np.full((len(n), max(n.max(), m.max()) + width), -2, np.int32)
    for i, (x, y) in enumerate(zip(short, long)):
        a[: len(x), i], b[i, most : most + len(y)] = x, y
    one, full, top = np.uint64(1), np.uint64((1 << width) - 1), np.uint64(1 << 2 * most)
    up, down = np.full(len(n), ((1 << width) - 1 << most) & (1 << width) - 1, np.uint64), np.zeros(len(n), np.uint64)
    score, bits = np.full(len(n), most, np.int64), np.zeros((len(n), 8), np.uint8)
    for j in range(len(a)):
        bits[:, : (width + 7) // 8] = np.packbits(b[:, j : j + width] == a[j][:, None], axis=1, bitorder="little")
        x, on = bits.view("<u8")[:, 0], j < n
        d = ((((x & up) + up) ^ up) | x | down) & full
        hp, hn = (down | ~(d | up)) & full, d & up
        score += on & (d & top == 0)
        up, down = np.where(on, (hn | ~((d >> one) | hp)) & full, up), np.where(on, (d >> one) & hp, down)
    # the band's last cell lies at row n + most; walk up to the row of the last word
    rest = top - (one << (m - n + most).astype(np.uint64))
    return score + np.bitwise_count(down & rest) - np.bitwise_count(up & rest).astype(np.int64)


def words(line: bytes) -> list[bytes]:
    """Runs of bytes outside 20 and 09 to 0D; a character of three bytes or more is a word of its own."""
    return _WORD.findall(line)


def _starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of all texts in the buffer."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid, tail, large = ~WHITE[data], (data & 0xC0) == 0x80, data >= 0xE0
    within = large.copy()
    for _ in range(3):  # bytes of a large character after its first
        within[1:] |= within[:-1] & tail[1:]
    first = solid & large
    first[0] = solid[0]
    first[1:] |= solid[1:] & (~solid[:-1] | within[:-1] & ~tail[1:])
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = solid[edge]
    stops = np.flatnonzero(first | ~solid)
    at = np.flatnonzero(first[stops])
    return stops[at], np.append(stops, len(data))[at + 1]


class _Lines:
    """Lines with a word in them of a few texts, as ranges of words."""

    def __init__(self, text: pa.Array) -> None:
        self.data, off = buffers(text)
        self.start, self.end = _starts(self.data, off)
        cut = np.unique(np.concatenate([np.flatnonzero(self.data == 10), off]))
        at = np.searchsorted(self.start, cut)
        some = np.flatnonzero(at[1:] > at[:-1])
        self.first, self.last = at[:-1][some], at[1:][some]
        self.size = self.last - self.first
        self.text = np.searchsorted(off, self.start[self.first], "right") - 1
        self.count = np.bincount(self.text, minlength=len(off) - 1)
        self.number = np.arange(len(self.first)) - np.repeat(np.cumsum(self.count) - self.count, self.count)

    def hashes(self, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, hash of each line's sequence of words)."""
        h = hasher.words(self.data, self.start, self.end)
        return h, hasher.words(h.view(np.uint8), 8 * self.first, 8 * self.last)

    def keys(self, first: np.ndarray) -> pa.Array:
        """16 bytes that stand for each line; first: the hash of the lines by _FIRST."""
        both = np.stack([first, self.hashes(_SECOND)[1]], 1).astype("<u8")
        return pa.Array.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())

    def _counted(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of some lines as counted() has them, the place where each line's begin, their number)."""
        size = self.size[some]
        first = np.cumsum(size) - size
        word = np.repeat(self.first[some] - first, size) + np.arange(size.sum())
        return counted(np.repeat(np.arange(len(some)), size), _FIRST.words(self.data, self.start[word], self.end[word])), first, size

    def sketches(self, some: np.ndarray) -> np.ndarray:
        """(line, lane): the sketches of some lines."""
        if not len(some):
            return np.empty((0, len(_LANES)), np.uint64)
        word, first, _ = self._counted(some)
        bit = word % np.uint64(SKETCH)
        one = np.uint64(1) << (bit & np.uint64(63))
        lanes = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == np.uint64(k), one, np.uint64(0)), first) for k in range(len(_LANES))]
        return np.stack(lanes, 1)

    def wide(self, some: np.ndarray) -> list[bytes | None]:
        """The wide sketches of some lines, None for those of few words."""
        word, first, size = self._counted(some)
        return [parity(word[x : x + n]).tobytes() if n >= WIDE else None for x, n in zip(first.tolist(), size.tolist())]

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[self.first[i]] : self.end[self.last[i] - 1]].tobytes()


_SHORT = np.uint64((1 << 48) - 1)


def _reach(size: np.ndarray) -> np.ndarray:
    """Words of a window that a segment of a line of this many words has at least, in few classes; 0: no partners but equal ones."""
    return np.select([size >= 72, size >= 18, size >= 9], [8, 6, 4], 0)


def _segments(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the segments of each line: one more than the edits to any longer line; they are almost equal."""
    count = size // (WORDS_AN_EDIT - 1) + 1
    line = np.repeat(np.arange(len(size)), count)
    i = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    return line, i * size[line] // count[line]


def entries(p: _Lines) -> tuple[np.ndarray, np.ndarray]:
    """(signature, entry): those of each distinct line's segments, and its probes for the segments of lines no longer than it."""
    h, line_hash = p.hashes(_FIRST)
    one = np.zeros(len(line_hash), bool)
    one[np.unique(line_hash, return_index=True)[1]] = True
    gram, out, sigs = _FIRST.windows(h, GRAM), [], []
    if not len(gram):
        return np.empty(0, np.uint64), np.empty(0, _ENTRY)
    of = np.repeat(np.arange(len(p.size)), p.size)
    room = p.last[of] - np.arange(len(of))  # words from here to the line's end
    beside = {}  # one word beside an anchor, or two where windows have the room: to the left (before a place), to the right (from it on)
    for k in (1, 2):
        w = np.zeros(len(h) + 2 * GRAM, np.uint16)
        w[GRAM : GRAM + len(h) - k + 1] = _FIRST.windows(h, k) & np.uint64(_MOST)
        beside[k] = w

    def put(line: np.ndarray, at: np.ndarray, kind: np.ndarray, reach: int) -> None:
        row = np.empty(len(at), _ENTRY)
        sig = mix(gram[at] ^ np.uint64(reach))
        row["sig"], row["sig2"] = sig & np.uint64(0xFFFFFFFF), (sig >> np.uint64(32)) & np.uint64(255)
        row["id"], row["id2"] = line_hash[line] & np.uint64(0xFFFFFFFF), (line_hash[line] >> np.uint64(32)) & np.uint64(_MOST)
        row["size"], row["place"] = np.minimum(p.size[line], _MOST), np.minimum(at - p.first[line], _MOST)
        k = 1 if reach < 6 else 2
        row["left"], row["right"], row["kind"] = beside[k][at + GRAM - k], beside[k][at + 2 * GRAM], kind
        out.append(row)
        sigs.append(sig)

    for reach in (4, 6, 8):
        anchor = argmin(gram, reach - GRAM + 1)
        mine = np.flatnonzero(one & (_reach(p.size) == reach))
        line, place = _segments(p.size[mine])
        line = mine[line]
        begin = p.first[line] + place
        put(line, anchor[begin], np.where(anchor[begin] - begin >= (1 if reach < 6 else 2), LEFT, RIGHT), reach)
        least = p.size - p.size // WORDS_AN_EDIT
        meets = one & (p.size >= WORDS_AN_EDIT) & (_reach(least) <= reach) & (_reach(p.size) >= reach)
        some = np.zeros(len(gram), bool)
        some[anchor[(meets[of] & (room >= reach))[: len(anchor)]]] = True
        at = np.flatnonzero(some)
        put(of[at], at, np.full(len(at), PROBE), reach)
    return np.concatenate(sigs), np.concatenate(out)


def _wide(r: np.ndarray, low: str, high: str) -> np.ndarray:
    return r[low].astype(np.uint64) | r[high].astype(np.uint64) << np.uint64(32)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments a and windows b lie so, in lines so long, that the edits suffice."""
    long, moved = b["size"].astype(np.int64), b["place"].astype(np.int64) - a["place"]
    fits = np.abs(moved) + np.abs(long - a["size"] - moved) <= long // WORDS_AN_EDIT
    return fits | (long == _MOST) | (b["place"] == _MOST)


def _spans(low: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): row j with each i of its span of count[j] rows from low[j] on; not too many at once."""
    some = np.flatnonzero(count)
    ends, x = np.cumsum(count[some]), 0
    while x < len(some):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + (1 << 19), "right")))
        n = count[some[x:y]]
        yield np.repeat(low[some[x:y]] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(some[x:y], n)
        x = y


def _ids(r: np.ndarray) -> np.ndarray:
    return _wide(r, "id", "id2")


def _meet(segments: np.ndarray, probes: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs of short ids, rows (key, id, span) of entries to look at again).

    A segment and a window meet if anchor and words beside it agree and lengths and places allow the edits. A window that has
    more than `few` segments in its reach is paired with the first of them, and the key's entries are handed on. A line may repeat one
    anchor any number of times: all its segments, or windows, under a key are one row, with the least and the greatest of their places.
    """
    found, again, shift = [np.empty((0, 2), np.uint64)], [np.empty((0, 3), np.uint64)], np.uint64(16)
    for side, kind in (("left", LEFT), ("right", RIGHT)):
        key = lambda r: mix((_wide(r, "sig", "sig2") << shift | r[side].astype(np.uint64)) + np.uint64(kind))  # noqa: E731, B023
        a, b = segments[segments["kind"] == kind], probes[probes["kind"] == PROBE]
        ka, kb = key(a), key(b)
        low_bits = np.uint64(_MOST)
        table = ka & ~low_bits | a["size"].astype(np.uint64)
        order = np.lexsort((_ids(a), table))
        a, ka, table = a[order], ka[order], table[order]
        size = b["size"].astype(np.int64)
        low = np.searchsorted(table, kb & ~low_bits | (size - size // WORDS_AN_EDIT).astype(np.uint64))
        count = np.searchsorted(table, kb & ~low_bits | size.astype(np.uint64), "right") - low
        for i, j in _spans(low, np.minimum(count, few)):
            fits = _fits(a[i], b[j])
            u, v = _ids(a[i[fits]]), _ids(b[j[fits]])
            found.append(_distinct(np.stack([np.minimum(u, v), np.maximum(u, v)], 1)[u != v]))
        more = np.unique(kb[count > few] & ~low_bits)
        if len(more):
            for r, k in ((a, ka), (b, kb)):
                hit = np.isin(k & ~low_bits, more)
                r = r[hit]
                at = (r["kind"] == PROBE).astype(np.uint64) << np.uint64(32) | r["size"].astype(np.uint64) << shift | r["place"].astype(np.uint64)
                again.append(_ranges(_distinct(np.stack([k[hit] & ~low_bits, _ids(r), at], 1))))
    return _distinct(np.concatenate(found)), np.concatenate(again)


def _ranges(rows: np.ndarray) -> np.ndarray:
    """Sorted rows (key, id, kind, size and place) as (key, id, span): probe or not, size, least and greatest place, of 16 bits each."""
    if not len(rows):
        return rows
    shift, own = np.uint64(16), rows.copy()
    own[:, 2] >>= shift
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(1)))
    low, high = (rows[at, 2] & np.uint64(_MOST) for at in (first, np.append(first[1:], len(rows)) - 1))
    own = own[first]
    own[:, 2] = own[:, 2] << np.uint64(32) | low << shift | high
    return own


def _alike(a: np.ndarray, b: np.ndarray, size: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """Whether sketches a and b allow the edits of lines whose longer one has `size` words, so many more than the other."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= 2 * (size.astype(np.int64) // WORDS_AN_EDIT) - more


def _across(key: np.ndarray, ident: np.ndarray, size: np.ndarray, probe: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, sketch: np.ndarray, known: np.ndarray, wide: Sequence[bytes | None] | None = None) -> np.ndarray:
    """Distinct pairs of short ids of one key but different labels that may fit.

    A row stands for all segments, or all windows (probe), of a line under the key; low, high: the least and the greatest of
    their places. known: which rows have a sketch; wide: their wide sketches, or None.
    """
    wide = None if wide is None else [None if x is None else np.frombuffer(x, "<u8") for x in wide]
    size, low, high = (x.astype(np.int64) for x in (size, low, high))
    kid, lid = np.unique(key, return_inverse=True)[1], np.unique(label, return_inverse=True)[1]
    both, width = kid * (int(lid.max(initial=0)) + 1) + lid, int(lid.max(initial=0)) + 1
    ia = np.flatnonzero(~probe)
    ia = ia[np.argsort(both[ia], kind="stable")]
    ib = np.flatnonzero(probe)
    where = lambda x, side: np.searchsorted(both[ia], x, side)
    own = where(both[ib], "left"), where(both[ib], "right")
    found = [np.empty((0, 2), np.int64)]
    for first, top in ((where(kid[ib] * width, "left"), own[0]), (own[1], where((kid[ib] + 1) * width, "left"))):
        for i, j in _spans(first, top - first):
            i, j = ia[i], ib[j]
            # a place moves by the words that the longer line has more, but for half of the edits left over
            more = size[j] - size[i]
            rest = size[j] // WORDS_AN_EDIT - more
            fits = (rest >= 0) & (low[j] - high[i] <= more + rest // 2) & (high[j] - low[i] >= -(rest // 2))
            fits = (more >= 0) & (fits | (size[j] == _MOST))
            i, j, more = i[fits], j[fits], more[fits]
            fits = _alike(sketch[i], sketch[j], size[j], more) | ~(known[i] & known[j]) | (size[j] == _MOST)
            i, j, more = i[fits], j[fits], more[fits]
            if wide is not None:
                fits = (differing(wide, i, j) <= 2 * (size[j] // WORDS_AN_EDIT) - more) | (size[j] == _MOST)
                i, j = i[fits], j[fits]
            u, v = ident[i], ident[j]
            found.append(_distinct(np.stack([np.minimum(u, v), np.maximum(u, v)], 1)[u != v]))
    return _distinct(np.concatenate(found))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))] if len(pairs) else pairs


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) for each run of rows that agree in their first `keys` columns; rows must be used up in turn."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return ((k, g) for k, g in groupby(rows, key=lambda r: r[:keys]))


_MET = "u bigint, v bigint, at bigint, bucket bigint, block int, rows binary"


def _met(pairs: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Rows (u, v) of pairs, and rows (u, bucket, at) of entries to look at again, where bucket is the key and at their span."""
    n, m = len(pairs), len(again)
    ints = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
    join = lambda x, y: pa.concat_arrays([x, y])
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays(
        [join(ints(pairs[:, 0]), ints(again[:, 1])), join(ints(pairs[:, 1]), none(m)), join(none(n), ints(again[:, 2])), join(none(n), ints(again[:, 0])), pa.nulls(n + m, pa.int32()), pa.nulls(n + m, pa.binary())],
        ["u", "v", "at", "bucket", "block", "rows"],
    )


def candidates(docs: DataFrame, total: int, home: str) -> tuple[DataFrame, DataFrame]:
    """((u, v): pairs of short ids of lines that may be within the edits; (key, short, size, probe, low, high): entries to look at again).

    total: words of docs. Entries are dealt to buckets by signature. A bucket of more than BLOCK_BYTES is passed on in blocks
    of that size, and every two of these meet in a task of their own, so that a frequent anchor fills no worker's memory.
    """
    buckets = max(64, total // 2 * _ENTRY.itemsize // (8 << 20))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 0, 1 << 20):
            sig, row = entries(_Lines(b.column(0)))
            if not len(row):
                continue
            at = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            heads, first = np.unique(at[order], return_index=True)
            row, ends = row[order], np.append(first[1:], len(row))
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array([row[x:y].tobytes() for x, y in zip(first, ends)], pa.binary())], ["bucket", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _runs(batches, 1):
            held, size, block = [], 0, 0
            for _, raw in rows:
                held.append(raw)
                size += len(raw)
                if size > BLOCK_BYTES:
                    yield _passed(bucket, block, held)
                    held, size, block = [], 0, block + 1
            if block and held:
                yield _passed(bucket, block, held)
            elif held:
                r = np.frombuffer(b"".join(held), _ENTRY)
                yield _met(*_meet(r, r))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), rows in _runs(batches, 3):
            r = {k: np.frombuffer(raw, _ENTRY) for *_, k, raw in rows}
            yield _met(*_meet(r[x], r[y]))
            if x != y:
                yield _met(*_meet(r[y], r[x]))

    dealt = docs.select("text").mapInArrow(put, "bucket bigint, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    met = stored(dealt.mapInArrow(meet, _MET), f"{home}/met")
    over = met.where("rows IS NOT NULL").select("bucket", "block", "rows")
    cells = over.join(over.groupBy("bucket").agg(F.max("block").alias("top")), "bucket").select("*", F.explode(F.sequence(F.lit(0), "top")).alias("o"))
    cells = cells.select("bucket", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "rows")
    by = ["bucket", "x", "y"]
    rest = cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(cross, _MET)
    rest = stored(rest.select("u", "v", "at", "bucket"), f"{home}/rest")
    part = lambda n: F.shiftright("at", n).bitwiseAND(_MOST).cast("int")
    spans = lambda df: df.where("v IS NULL").select(F.col("bucket").alias("key"), F.col("u").alias("short"), part(32).alias("size"), (part(48) > 0).alias("probe"), part(16).alias("low"), part(0).alias("high"))
    # a key is met in one task; only those of a bucket in blocks come out of several
    merged = spans(rest).groupBy("key", "short", "size", "probe").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = met.where("v IS NOT NULL").select("u", "v").union(rest.where("v IS NOT NULL").select("u", "v"))
    return stored(pairs.distinct(), f"{home}/candidates"), spans(met.where("rows IS NULL")).union(merged)


def _passed(bucket: int, block: int, held: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array([bucket]), pa.array([block], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["u", "v", "at", "bucket", "block", "rows"])


def _celled(rows: DataFrame) -> DataFrame:
    """rows, with the number of `blocks` of their key, dealt to cells, which take the place of `key`: a key of several blocks is cut, and
    each block of segments meets each block of windows in a cell of its own. Should two cells share a number, more is compared, not less."""
    own = F.pmod(F.xxhash64("short", "size", "probe"), F.col("blocks"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cell = F.when(F.col("probe"), F.xxhash64("key", "other", own)).otherwise(F.xxhash64("key", own, "other"))
    return met.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(cell)).drop("blocks", "other")


def links(named: DataFrame, every: DataFrame, total: int, home: str) -> DataFrame:
    """(u, v): keys of different lines within the edits that join all that such links join; every: the lines of named."""
    pairs, again = candidates(named, total, home)
    ids = pairs.select(F.col("u").alias("short")).union(pairs.select("v")).union(again.select("short")).distinct()
    ids = stored(ids, f"{home}/ids")
    # each line is cut from one text that has it
    asked = flagged(every, ids, "short").where("_flag").join(ids, "short", "left_semi").groupBy("id").agg(F.min(F.struct("t", "no", "short")).alias("at"))
    asked = asked.groupBy(F.col("at.t").alias("t")).agg(F.collect_list(F.struct(F.col("at.no").alias("no"), F.col("at.short").alias("short"), "id")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 0):
            p, rows = _Lines(b.column(0)), []
            head = np.cumsum(p.count) - p.count
            for i, some in enumerate(b.column(1).to_pylist()):
                rows += [(x["short"], x["id"], head[i] + x["no"]) for x in some]
            short, key, at = zip(*rows)
            lanes = p.sketches(np.array(at)).view(np.int64)
            made = [pa.array(short, pa.int64()), pa.array(key, pa.binary()), pa.array([p.bytes(i) for i in at], pa.binary()), pa.array(p.size[list(at)], pa.int32())]
            lanes = [*(pa.array(lanes[:, k]) for k in range(len(_LANES))), pa.array(p.wide(np.array(at)), pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, *lanes], ["short", "key", "line", "size", *_LANES, "wide"])

    texts = flagged(named, asked, "t").where("_flag").select("t", "text").dropDuplicates(["t"]).join(asked, "t")
    lines = stored(texts.select("text", "asked").mapInArrow(cut, "short bigint, key binary, line binary, size int, " + ", ".join(f"{x} bigint" for x in _LANES) + ", wide binary"), f"{home}/lines")

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(near_pairs(a.to_pylist(), b.to_pylist()), pa.bool_())

    side = lambda u, *more: lines.select(F.col("short").alias(u), *(F.col(c).alias(f"{u}_{c}") for c in ("key", *more)))
    most = F.expr(f"greatest(u_size, v_size) div {WORDS_AN_EDIT}")
    more = F.abs(F.col("u_size") - F.col("v_size"))
    differ = sum((F.bit_count(F.col(f"u_{x}").bitwiseXOR(F.col(f"v_{x}"))) for x in _LANES), F.lit(0))

    def compared(pairs: DataFrame) -> DataFrame:
        # texts go only with the pairs that sketches and sizes leave
        two = pairs.join(side("u", "size", *_LANES), "u").join(side("v", "size", *_LANES), "v").where((differ <= 2 * most - more) & (more <= most))
        text = lambda u: lines.select(F.col("key").alias(f"{u}_key"), F.col("line").alias(f"{u}_line"))
        two = two.select("u_key", "v_key").join(text("u"), "u_key").join(text("v"), "v_key")
        return two.where(near("u_line", "v_line")).select(F.col("u_key").alias("u"), F.col("v_key").alias("v"))

    first = stored(compared(pairs), f"{home}/first")
    klass = stored(components(first), f"{home}/labels")
    label = left_join_few(lines.select("short", "key", *_LANES, "wide"), klass.withColumnRenamed("node", "key"), "key")
    label = label.groupBy("short").agg(F.min(F.xxhash64(F.coalesce("component", "key"))).alias("label"), F.count(F.lit(1)).alias("n"), *(F.min(x).alias(x) for x in [*_LANES, "wide"]))
    # lines that share a short id belong to no class here and have no sketch, so that each is compared
    one = F.col("n") == 1
    label = label.select("short", F.when(one, F.col("label")).otherwise(F.xxhash64("short", "n")).alias("label"), *_LANES, one.alias("known"), F.when(one, F.col("wide")).alias("wide"))
    label = stored(label, f"{home}/label")
    labelled = stored(again.join(label.select("short", "label"), "short"), f"{home}/again")
    blocks = F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("blocks")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), blocks).where("a <> b").select("key", "blocks")
    mixed = stored(mixed, f"{home}/mixed")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(c: list[np.ndarray]) -> pa.RecordBatch:
            *row, label = c[:7]
            pairs = _across(*row, label, np.stack(c[7:-2], 1).view(np.uint64), c[-2], c[-1])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            if not len(c[0]):
                continue
            last = int(np.searchsorted(c[0], c[0][-1]))  # where the last key begins, which may go on
            if last or (held and held[-1][0][-1] != c[0][0]):
                yield done([np.concatenate([*(h[i] for h in held), c[i][:last]]) for i in range(len(c))])
                held = []
            held.append([x[last:] for x in c])
        if held:
            yield done([np.concatenate(x) for x in zip(*held)])

    some = flagged(labelled, mixed, "key").where("_flag").drop("_flag").join(mixed, "key").join(label.drop("label"), "short")
    cells = _celled(some).select("key", "short", "size", "probe", "low", "high", "label", *_LANES, "known", "wide")
    rest = cells.repartition("key").sortWithinPartitions("key").mapInArrow(across, "u bigint, v bigint")
    # pairs are few bytes but much work, so partitions aren't to be joined by their size
    spark = named.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = rest.repartition(n, "u", "v").distinct()
    second = stored(compared(rest), f"{home}/second")
    return first.union(second)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_text.

    Lines are parted by line feeds; those without words don't count. Words are runs of bytes outside 20 and 09 to 0D
    (hexadecimal), and each character of three bytes or more in UTF-8 is one. Lines of equal words, and lines that one edit
    of a word for each WORDS_AN_EDIT words of the longer one turns into each other, are linked. Of all lines that links join, the
    first stays: smallest id (a null id last), then least key of id and text, then least line number; kept_text has the lines that stay,
    from their first word to their last, joined by line feeds. Null and empty texts have no lines; rows repeated with one id
    and text keep the same lines; an empty table gives no rows; other columns are ignored.
    """
    spark, before = docs.sparkSession, len(made)
    home = shared_dir(spark, "lines")
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.withColumn("t", text_key(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text")))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            p = _Lines(b.column(2))
            of = pa.array(p.text)
            h = p.hashes(_FIRST)[1]
            own = [pa.array(p.number.astype(np.int32)), p.keys(h), pa.array((h & _SHORT).astype(np.int64)), pa.array(p.size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *own], ["doc_id", "t", "no", "id", "short", "size"])

    every = stored(named.select("doc_id", "t", "text").mapInArrow(lines, "doc_id bigint, t binary, no int, id binary, short bigint, size int"), f"{home}/all")
    n, total = every.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    klass = stored(components(links(named, every, total, home)), f"{home}/classes")
    joined = left_join_few(every.drop("size", "short"), klass.withColumnRenamed("node", "id"), "id").withColumn("class", F.coalesce("component", "id"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "no")
    best = stored(joined.groupBy("class").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{home}/best")
    seen = left_join_hot(joined.select("doc_id", "t", "no", "class"), best.select("class", "best"), "class", n, best.select("class", "n"))
    gone = seen.where(F.col("best").isNotNull() & ~place.eqNullSafe(F.col("best")))
    dropped = stored(gone.groupBy("t").agg(F.collect_set("no").alias("gone")), f"{home}/gone")
    rows = left_join_few(named, dropped, "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            p, kept = _Lines(b.column(1)), []
            ends, lost = np.append(0, np.cumsum(p.count)), b.column(2).to_pylist()
            for i, g in enumerate(lost):
                g = set(g or ())
                kept.append(b"\n".join(p.bytes(k) for k in range(ends[i], ends[i + 1]) if k - ends[i] not in g).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.count, pa.int64()), pa.array([len(set(g or ())) for g in lost], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return swept(rows.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string"), before)
