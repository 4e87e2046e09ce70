"""Array kernels over UTF-8 text: words, their hashes and those of word k-grams, without a Python loop over words.

A chunk is some documents' bytes, one after the other. Words end at documents' ends. Hashes have
64 bits: sums of a value for each byte times a power of an odd number, modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]

#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after A-Z are lower-cased).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n-1 of _ODD and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = _U(pow(int(_ODD), -1, 1 << 64))
        for i, base in enumerate((_ODD, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            _powers[i] = p
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offs, np.int64, n + 1, at * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, data


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes), of about limit bytes and at most so many rows; a longer text is a chunk of its own."""
    offs, data = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        lo = hi


@dataclass
class Words:
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    doc: np.ndarray  # the document's number in the chunk
    count: np.ndarray  # words of each document
    first: np.ndarray  # number of the first word of each document
    prefix: np.ndarray  # sums of the bytes' values before each byte

    def hashes(self, most: int | None = None, least: int | None = None) -> np.ndarray:
        """Hashes of the words; with most, of their first bytes; with least, of their last bytes."""
        s, e = self.start, self.end
        if most is not None:
            e = np.minimum(e, s + most)
        if least is not None:
            s = np.maximum(s, e - least)
        _, inverse = powers(len(self.prefix))
        return mix((self.prefix[e] - self.prefix[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)


def words(offs: np.ndarray, data: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> Words:
    n, docs = len(data), len(offs) - 1
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offs, start, "right") - 1
    count = np.bincount(doc, minlength=docs).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if docs else count
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(n + 1)[0][:n], out=prefix[1:])
    return Words(start, end, doc, count, first, prefix)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k entries of h (those across documents too; mask them by valid())."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD + h[j : j + n]
    return mix(out + np.array([k], np.uint64) * _STEP)


def valid(doc: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one document."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence, for documents with fewer than k words."""
    out = 0
    for x in h.tolist():
        out = (out * int(_ODD) + x) & (2**64 - 1)
    return int(mix(np.array([(out + len(h) * int(_STEP)) & (2**64 - 1)], np.uint64))[0])
