"""Benchmark decontamination by q-gram counting in overlapping diagonal bands.

Texts and items are reduced to lower-case letters, digits and single spaces. For an item of m bytes the
edit budget is e = floor(rate * m). By the q-gram lemma a copy within e edits shares at least
m - q + 1 - e * q of the item's q-grams, and these lie on e + 1 neighbouring diagonals (text position
minus item position). Bands of 2 * (e + 1) diagonals, each overlapping the next by half, therefore have
one band that holds them all. Regions whose band reaches the bound are aligned (banded, ends in the text
free) and kept if the distance is within the budget. q is 8, or for short items the largest length that leaves a
bound of at least 1: floor(m / (e + 1)); so nothing within the budget is missed, whatever an item's length. A q-gram is
one 64-bit number: counts are of the q-grams themselves, not of hashes.

Items are a stated query set, held in blocks of at most BLOCK_BYTES; each block passes over all texts,
which stay where they are: there is no shuffle and no pair of documents.

Defined cases: a null text, or one without letters and digits, has no match; neither has such an item; an item of a few
letters matches wherever they stand, within words too; repeated items each match; repeated rows each match; an
empty table of either kind gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh
from .kernels import utf8

#: Length of q-grams; short items have shorter ones.
Q = 8
RATE = 0.1
#: Bytes of items whose q-grams are sent to the executors at once.
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 20
_FILTER_BITS = 20

_FOLD = np.full(256, 32, np.uint8)
for _a, _b, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
    _FOLD[_a:_b] = np.arange(_to, _to + _b - _a)


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with runs of other characters as one space, and the place in data of each."""
    out = _FOLD[data]
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and out[at[0]] == 32:
        at = at[1:]
    if len(at) and out[at[-1]] == 32:
        at = at[:-1]
    return out[at], at


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The runs of q bytes, each as a number."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.ndarray((n,), "<u8", np.ascontiguousarray(data).tobytes() + bytes(8), 0, (1,))
    return g if q == 8 else g & np.uint64((1 << 8 * q) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Grams:
    """The q-grams of those items that have q-grams of one length."""

    def __init__(self, q: int, items: list[int], text: list[np.ndarray]):
        self.q = q
        grams = [qgrams(text[i], q) for i in items]
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.item = np.repeat(items, [len(x) for x in grams])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in grams])[order]
        self.grams, self.start, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.grams)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and diagonal of each q-gram that data shares."""
        g = qgrams(data, self.q)
        at = np.flatnonzero(self.filter[_slot(g)])
        key = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        real = self.grams[key] == g[at]
        at, key = at[real], key[real]
        n = self.count[key]
        pos = np.repeat(at, n)
        ref = np.repeat(self.start[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.item[ref], pos - self.place[ref]


class Index:
    """Some items with their budgets, bounds and q-grams."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.text, self.budget, self.bound = [], [], [], []
        of_q: dict[int, list[int]] = {}
        for item_id, text in items:
            folded, _ = fold(np.frombuffer((text or "").encode(), np.uint8))
            if not len(folded):
                continue
            m, e = len(folded), int(rate * len(folded))
            q = min(Q, m // (e + 1))
            of_q.setdefault(q, []).append(len(self.ids))
            self.ids.append(item_id)
            self.text.append(folded)
            self.budget.append(e)
            self.bound.append(m - q + 1 - e * q)
        self.lengths = [Grams(q, of, self.text) for q, of in sorted(of_q.items())]
        self.step = np.array(self.budget, np.int64) + 1
        self.need = np.array(self.bound, np.int64)

    def regions(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, first and last diagonal) of the bands of folded data that reach their bound, the fullest first."""
        found = [x.hits(data) for x in self.lengths]
        item, diagonal = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        if not len(item):
            return []
        # Band b of an item with step s covers the diagonals from b*s to (b+2)*s - 1.
        half = diagonal // self.step[item]
        width = int(len(data)) + 4096
        code = item * (2 * width) + half + width
        cells, counts = np.unique(code, return_counts=True)
        owner, cell = cells // (2 * width), cells % (2 * width) - width
        joined = np.zeros(len(cells), np.int64)
        joined[:-1] = np.where((cells[1:] == cells[:-1] + 1), counts[1:], 0)
        good = np.flatnonzero(counts + joined >= self.need[owner])
        alone = np.flatnonzero(counts >= self.need[owner])  # the band that ends with this cell holds no more than this one
        good = np.union1d(good, alone)
        good = good[np.argsort(-(counts + joined)[good], kind="stable")]
        return [(int(owner[i]), int(cell[i] * self.step[owner[i]]), int((cell[i] + 2) * self.step[owner[i]] - 1)) for i in good]

    def align(self, i: int, data: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best alignment of item i in data whose diagonals are within the budget of [low, high]."""
        pattern, e = self.text[i], self.budget[i]
        a, b = max(0, low - e), min(len(data), high + e + len(pattern))
        whole = data[a:b].tobytes().find(pattern.tobytes())
        if whole >= 0:
            return 0, a + whole, a + whole + len(pattern)
        return banded(pattern, data[a:b], a, low - e, high + e, e)


def banded(pattern: np.ndarray, text: np.ndarray, offset: int, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Edit distance of pattern to its best place in text (which starts at offset), on diagonals low to high.

    Cells are (pattern row, diagonal). A cell that starts in the text costs nothing. Gives None over the budget.
    """
    if over_budget(pattern, text, low - offset, high - offset, budget):
        return None
    width = high - low + 1
    big = np.int32(1 << 28)
    diagonals = np.arange(low, high + 1) - offset
    n = len(text)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, big).astype(np.int32)
    begin = diagonals.astype(np.int64).copy()
    steps = np.arange(width, dtype=np.int32)
    for row, byte in enumerate(pattern):
        column = diagonals + row  # the text position that a match of this row would use
        inside = (column >= 0) & (column < n)
        same = np.zeros(width, bool)
        same[inside] = text[column[inside]] == byte
        straight = np.where(inside, cost + np.where(same, 0, 1), big)
        lost = np.append(cost[1:] + 1, big)  # the pattern's byte is not in the text: one diagonal down
        best = np.minimum(straight, lost)
        source = np.where(straight <= lost, begin, np.append(begin[1:], 0))
        # A byte of the text that is not in the pattern: one diagonal up, any number of times.
        best = np.where((column + 1 >= 0) & (column + 1 <= n), best, big)
        running = np.minimum.accumulate(best - steps)
        at = np.maximum.accumulate(np.where(best - steps == running, steps, 0))
        cost, begin = np.minimum(running + steps, big).astype(np.int32), source[at]
    best = int(cost.min())
    if best > budget:
        return None
    d = int(np.flatnonzero(cost == best)[0])
    return best, int(begin[d]) + offset, int(diagonals[d]) + len(pattern) + offset


def over_budget(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> bool:
    """Whether no place of text within the band is within the budget: the costs alone, left as soon as all are over it.

    The text is continued by bytes that match nothing; to use one costs as much as to lose the pattern's byte.
    """
    width, left, right = high - low + 1, max(0, -low), max(0, high + len(pattern) - len(text))
    text = np.concatenate((np.zeros(left, np.uint8), text, np.zeros(right, np.uint8)))
    steps = np.arange(width, dtype=np.int32)
    cost, lost = np.zeros(width, np.int32), np.full(width, 1 << 28, np.int32)
    for row, byte in enumerate(pattern):
        at = row + low + left
        np.add(cost[1:], 1, out=lost[:-1])
        cost += text[at : at + width] != byte
        np.minimum(cost, lost, out=cost)
        cost -= steps
        np.minimum.accumulate(cost, out=cost)
        cost += steps
        if row & 7 == 7 and cost.min() > budget:
            return True
    return bool(cost.min() > budget)


def matches_in(data: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of items in a document's bytes; the best place for each item."""
    folded, where = fold(data)
    found: dict[int, tuple[int, int, int]] = {}
    # Overlapping pieces bound the arrays; a copy that ends in one piece starts in it too.
    reach = 2 * max((len(t) for t in index.text), default=0) + 64
    lo = 0
    while lo < len(folded):
        piece = folded[lo : lo + CHUNK + reach]
        for i, low, high in index.regions(piece):
            if i in found and not found[i][0]:
                continue
            got = index.align(i, piece, low, high)
            if got and (i not in found or got[0] < found[i][0]):
                found[i] = (got[0], got[1] + lo, got[2] + lo)
        lo += CHUNK
    return [(i, e, int(where[s]) if s < len(where) else len(data), int(where[t - 1]) + 1 if t else 0) for i, (e, s, t) in sorted(found.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about so many bytes, in order of id; the driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id")
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1].encode())
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it holds: key, item_id, edits, budget, begin_byte, end_byte of the best place."""
    spark = docs.sparkSession
    key_type = dict(docs.dtypes)[key]
    schema = f"`{key}` {key_type}, item_id long, edits int, budget int, begin_byte long, end_byte long"
    out = []
    for block in item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Index(block, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            longest = max((len(t) for t in index.text), default=0)
            for batch in batches:
                offs, data = utf8(batch.column(1))
                rows: list[tuple] = []
                # Documents are searched many at a time, with a gap of 0 bytes that no q-gram of an item has.
                for group in _groups(offs):
                    rows += _search_group(group, offs, data, index, longest)
                rows.sort()
                picked = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([picked, *cols], names=[key, "item_id", "edits", "budget", "begin_byte", "end_byte"])

        out.append(docs.select(key, "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def _groups(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _search_group(group: tuple[int, int], offs: np.ndarray, data: np.ndarray, index: Index, longest: int) -> list[tuple]:
    lo, hi = group
    if hi - lo == 1:
        found = matches_in(data[offs[lo] : offs[hi]], index)
        return [(lo, index.ids[i], e, index.budget[i], s, t) for i, e, s, t in found]
    gap = np.zeros(2 * longest + Q, np.uint8)
    parts, wheres, starts, at = [], [], [], 0
    for d in range(lo, hi):
        folded, where = fold(data[offs[d] : offs[d + 1]])
        starts.append(at)
        parts += [folded, gap]
        wheres.append(where)
        at += len(folded) + len(gap)
    whole = np.concatenate(parts)
    begins = np.array(starts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, low, high in index.regions(whole):
        middle = (low + high) // 2 + len(index.text[i]) // 2
        k = int(np.clip(np.searchsorted(begins, middle, "right") - 1, 0, len(begins) - 1))
        for d in {k, min(k + 1, len(begins) - 1)}:  # the band's middle may lie in the gap before the document
            if (d, i) in best and not best[d, i][0]:
                continue
            folded = parts[2 * d]
            a, b = low - starts[d], high - starts[d]
            if b + len(index.text[i]) + index.budget[i] < 0 or a - index.budget[i] > len(folded):
                continue
            got = index.align(i, folded, a, b)
            if got and ((d, i) not in best or got[0] < best[d, i][0]):
                best[d, i] = got
    out = []
    for (d, i), (e, s, t) in best.items():
        where = wheres[d]
        size = int(offs[lo + d + 1] - offs[lo + d])
        out.append((lo + d, index.ids[i], e, index.budget[i], int(where[s]) if s < len(where) else size, int(where[t - 1]) + 1 if t else 0))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches only: doc_id, item_id, edits, budget, begin_byte, end_byte."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by a hash of id and text, not by the id alone."""
    key, hit = fresh(docs, "row_key", "hit_key")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = search(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key).select(F.col(key).alias(hit)).distinct()
    return rows.join(found, F.col(key) == F.col(hit), "left_anti").drop(key)
