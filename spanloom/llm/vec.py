"""Vectorised text primitives on Arrow string columns.

Every function works on the UTF-8 bytes of a whole Arrow batch at once; nothing
loops over words or characters in Python. Words are ``[^\\x20\\x09-\\x0D]+``, the
word class of the operators in this package. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; bounds its temporary arrays.
CHUNK_BYTES = 1 << 18


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (a, b) of at most ``limit`` bytes each, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word's index of each row (n + 1 long)."""
    if len(data) == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~space_table()[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[rows] = solid[rows]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random 64-bit value of each value; another function for each seed."""
    return mix64(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


#: Places in a word whose pairs with a byte are looked up; those behind are worked out.
_PLACES = 64
_TABLES: dict[int, np.ndarray] = {}


def pair_table(seed: int) -> np.ndarray:
    """The pseudo-random value of each (place, byte) of the first places."""
    if seed not in _TABLES:
        _TABLES[seed] = seeded(np.arange(_PLACES * 256, dtype=np.uint64), seed)
    return _TABLES[seed]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes; starts and ends rise.

    Each pair of a byte and its place in the word has a pseudo-random value of its own;
    a word is the mixed sum of its pairs and of its length. No algebra ties places
    to each other, as powers of one base would, so no family of words collides.
    """
    out = np.empty(len(starts), np.uint64)
    table = pair_table(seed)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, side="right")))
        low, high = int(starts[a]), int(ends[b - 1])
        s, size = (starts[a:b] - low).astype(np.int32), ends[a:b] - starts[a:b]
        # the bytes between words take part, but in no word's sum
        place = np.arange(high - low, dtype=np.int32) - np.repeat(s, np.diff(np.append(s, high - low)))
        long_ = np.flatnonzero(size > _PLACES)
        if len(long_):
            np.minimum(place, _PLACES - 1, out=place)
        elif len(place):
            place &= _PLACES - 1
        place <<= 8
        place |= data[low:high]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[place], out=total[1:])
        sums = total[s + size] - total[s]
        for w in long_.tolist():
            own = data[starts[a + w] : ends[a + w]]
            sums[w] = seeded((np.arange(len(own), dtype=np.uint64) << np.uint64(8)) | own, seed).sum(dtype=np.uint64)
        out[a:b] = seeded(sums + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), seed)
        a = b
    return out


def sequence_hashes(words: np.ndarray, first: np.ndarray, seed: int = 2) -> np.ndarray:
    """A hash of each row's words in their order; built as that of a word from its bytes."""
    n = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], n)
    pairs = seeded(words + seeded(place.astype(np.uint64), seed), seed + 1)
    return seeded(run_sums(pairs, first) + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), seed)


def doubled(level: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of 2 * width words from each index, given those of width words; the last ones run past the end."""
    behind = np.zeros_like(level)
    behind[: max(0, len(level) - width)] = level[width:]
    return seeded(level + seeded(behind, seed), seed + width)


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 3) -> np.ndarray:
    """Hashes of words[start:end], none of them empty.

    The hashes of 1, 2, 4, ... words from each index come from each other; a range is
    covered by the two widest that start and end with it, which hold all its words.
    """
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    level, width = words, 1
    while len(starts):
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(own):
            both = level[starts[own]] + seeded(level[ends[own] - width], seed + 1)
            out[own] = seeded(both + size[own].astype(np.uint64) * np.uint64(0xA24BAED4963EE407), seed)
        if 2 * width > int(size.max()):
            break
        level = doubled(level, width, seed)
        width *= 2
    return out


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, seed: int = 3) -> np.ndarray:
    """Hashes of ``size`` consecutive words from each index in ``at``."""
    return range_hashes(words, at, at + size, seed)


def window_starts(first: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row and word index of every window of ``size`` words that lies in one row.

    first: the first word's index of each row (n + 1 long). step: 1 for rolling
    windows, ``size`` for non-overlapping ones counted from the row's first word.
    """
    n = np.diff(first)
    each = np.where(n >= size, (n - size) // step + 1, 0)
    row = np.repeat(np.arange(len(n)), each)
    before = np.cumsum(each) - each
    rank = np.arange(len(row)) - before[row]
    return row, first[:-1][row] + rank * step
