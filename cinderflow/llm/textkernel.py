"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so they are found in UTF-8 as it is. Their
64-bit hashes come from one running polynomial sum; A-Z are lower-cased first.
"""

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEGMENT = 1 << 20
#: Odd multipliers by place in an n-gram.
_PLACES = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(32)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def trimmed(run):
    """run (batches to batches), giving freed memory back at its end: Python workers outlive their tasks and wait for more."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each text begins and the last ends. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of documents with about limit bytes of text each; one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words in text order: document (counted from 0), first byte, byte after the last, hash."""

    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def firsts(self) -> np.ndarray:
        """Index of the first word of each document, and the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every n consecutive words of a document: index of the first, and the hash."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        total = np.full(m, np.uint64(n))
        for i in range(n):
            total += self.hash[i : i + m] * _PLACES[i]
        return at, mix(total[at])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]].

    Works through segments of about a megabyte that end between words, so that a very long text
    needs no more than its words' arrays.
    """
    n, size = len(offsets) - 1, len(data)
    starts, ends, hashes = [], [], []
    # A text that ends within a word ends that word: texts' first bytes are breaks as well.
    breaks = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]) if n else np.zeros(0, np.int64)
    p = 0
    while p < size:
        q = min(p + _SEGMENT, size)
        while q < size:  # on to a space or the end of a text
            more = data[q : q + _SEGMENT]
            space = np.flatnonzero(_SPACE[more])
            stop = q + int(space[0]) if len(space) else q + len(more)
            k = np.searchsorted(breaks, q)
            if k < len(breaks):
                stop = min(stop, int(breaks[k]))
            full = not len(space) and stop == q + len(more)
            q = stop
            if not full:
                break
        seg = data[p:q]
        inside = ~_SPACE[seg]
        opens = np.empty(len(seg), bool)
        opens[0] = True
        opens[1:] = ~inside[:-1]
        b = breaks[np.searchsorted(breaks, p) : np.searchsorted(breaks, q)] - p
        opens[b] = True
        s = np.flatnonzero(opens & inside)
        closes = np.empty(len(seg), bool)
        closes[-1] = True
        closes[:-1] = ~inside[1:]
        closes[b[b > 0] - 1] = True
        e = np.flatnonzero(closes & inside) + 1
        low = _LOWER[seg] if lower else seg
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(seg)), out=sums[1:])
        h = (sums[e] - sums[s]) * _power("down", _INVERSE, len(seg) + 1)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * _PLACES[31]))
        starts.append(s + p)
        ends.append(e + p)
        p = q
    if not starts:
        z = np.zeros(0, np.int64)
        return Words(n, z.astype(np.int32), z, z, z.astype(np.uint64))
    start = np.concatenate(starts)
    return Words(n, (np.searchsorted(offsets, start, "right") - 1).astype(np.int32), start, np.concatenate(ends), np.concatenate(hashes))


def hash_text(text: str, lower: bool = True) -> list[int]:
    """Hashes of the words of one text."""
    data, offsets = flat(pa.array([text]))
    return words(data, offsets, lower).hash.tolist()
