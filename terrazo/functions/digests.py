"""MD5 of many short texts at once, for orders by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are hashed in one go, so that all words stay in a core's cache.
AT_ONCE = 8192
#: Longest text that fits in MD5's block.
LONGEST = 55
_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def suffixes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each text, zeros behind it, and the texts' lengths. A null is an empty text."""
    texts = pc.cast(texts, pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8)
    long = np.diff(ends)
    width = int(long.max(initial=0))
    at = np.arange(width)
    return np.where(at < long[:, None], data[np.minimum(ends[:-1, None] + at, len(data) - 1)], 0).astype(np.uint8), long


def blocks(tails: np.ndarray, long: np.ndarray, head: int) -> np.ndarray:
    """MD5's blocks, 16 words (rows) for each text (columns), with room for a head of so many bytes before each tail."""
    if head + tails.shape[1] > LONGEST:
        raise ValueError(f"texts of at most {LONGEST} bytes")
    b = np.zeros((len(tails), 64), np.uint8)
    b[:, head : head + tails.shape[1]] = tails
    b[np.arange(len(tails)), head + long] = 0x80
    b[:, 56:58] = ((head + long) * 8).astype("<u2")[:, None].view(np.uint8)
    return np.ascontiguousarray(b.view("<u4").T)


def _digest(words: np.ndarray, first: int) -> np.ndarray:
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    m = [w if w.any() else None for w in words]
    m[0] = words[0] | np.uint32(first)
    for i in range(64):
        k, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if k < 2:
            x, y, z = (b, c, d) if k == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif k == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_K[i]), out=f)
        if m[g] is not None:
            np.add(f, m[g], out=f)
        turn = _TURN[k][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, f, b, c, d = d, a, f, b, c
    return np.stack([x + np.uint32(y) for x, y in ((a, 0x67452301), (b, 0xEFCDAB89), (c, 0x98BADCFE), (d, 0x10325476))])


def md5(words: np.ndarray, head: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The digests of head (up to four bytes) and tails, from blocks with room for it: the first and the last 64 bits as whole numbers."""
    first = int.from_bytes(head, "little")
    out = np.empty((4, words.shape[1]), np.uint32)
    for i in range(0, words.shape[1], AT_ONCE):
        out[:, i : i + AT_ONCE] = _digest(words[:, i : i + AT_ONCE], first)
    w = out.byteswap().astype(np.uint64)
    return w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3]
