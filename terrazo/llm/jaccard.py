"""N-gram Jaccard join by a token-group matrix.

A document's tokens are its distinct word n-grams (64-bit hashes). Two documents link when
100 * intersection >= PERCENT * union. What is returned is each document's class: the smallest doc_id that
links reach.

1. Documents with the same set are one (by a 128-bit hash of the set).
2. Similar documents are put into groups: equal pairs of minima under two hash functions. A group larger than
   PIECE is dealt into pieces by hash. A piece is stored as its token union and a bit matrix, members by tokens.
3. In each piece, and between pieces of a group (each against the group's first) and of documents that
   share another pair of minima (each against the first), links are found. These linear joins bring nearly
   all copies into one class, whatever the size of the group.
   Then neighbours by size in the postings of step 4 are tried, which is linear too.
4. What is left is found exactly. Under any order of tokens two linked sets share one of the first
   n - ceil(n * PERCENT / 100) + 1 tokens. Pieces post those of their members. Postings are counted by token before any
   moves: tokens of one class are passed over; else the pieces of different classes are a query piece and a group piece. Tokens
   posted by more than FEW classes, and tokens of many classes in the documents that post those, go to the end of
   the order and the postings are made anew, so that a passage in many documents posts nothing unless a document consists of it.
   At most PUT_BACK tokens go back, those of the most classes. Postings meet only where sizes leave room for a link, and
   pairs go on only if they share as many posted tokens as a link must.
5. For each pair of pieces the bound is taken first: a member's tokens in the other's union, against what its size
   needs. Only members that reach it are opened, by a product of the bit matrices.
6. Classes are connected components of the links.

No pair of documents becomes a row: rows are links of members to the first they meet in a piece, or pairs of pieces.

Defined cases: a null or wordless text has 0 shingles and is a class of its own; fewer than n words are one token;
a null doc_id gets the class of its equals, null if it has none; rows that share a doc_id are one node, whose classes
merge; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, small
from .components import components
from .kernels import LOWER_VALUES, NOT_SPACE, chunks, grams, sequence_hash, valid, words

N = 4
PERCENT = 85
#: Members of a piece; pairs of minima of a document; classes that may post one token before it is put back.
PIECE, BANDS, FEW = 64, 5, 32
#: Tokens put back, which are sent to every executor: those of the most classes, if there are more.
PUT_BACK = 1_000_000
#: Columns of a bit matrix that are opened at once.
COLUMNS = 1 << 16
#: A token is so many bits of its words' hash; a document's number in its chunk takes the others.
TOKEN_BITS = 54
#: Share (one in so many documents, by hash) that tokens to put back are looked for in.
LOOK_IN = 16
_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)


def token_sets(offs: np.ndarray, data: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each document, one after the other, and how many each has. A chunk has at most 1000 documents."""
    w = words(offs, data, NOT_SPACE, LOWER_VALUES)
    h = w.hashes()
    ok = valid(w.doc, n)
    g, doc = grams(h, n)[ok], w.doc[: len(ok)][ok]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        whole = np.array([sequence_hash(h[w.first[d] : w.first[d] + w.count[d]]) for d in short], np.uint64)
        g, doc = np.concatenate((g, whole)), np.concatenate((doc, short))
    key = (doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (g >> np.uint64(64 - TOKEN_BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    count = np.bincount((key >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=len(offs) - 1).astype(np.int64)
    return key & np.uint64((1 << TOKEN_BITS) - 1), count


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, offs, data in chunks(batch.column(1)):
            g, count = token_sets(offs, data, n)
            ends = np.cumsum(count)
            some = np.flatnonzero(count)
            minima = np.zeros((hi - lo, 2 * BANDS), np.uint64)
            if len(some):
                for j, m in enumerate(_MULTIPLIERS):
                    minima[some, j] = np.minimum.reduceat(g * m, (ends - count)[some])
            pairs = minima[:, 0::2] * np.uint64(0x9E3779B97F4A7C15) ^ (minima[:, 1::2] + np.arange(1, BANDS + 1, dtype=np.uint64))
            digest = [xxhash.xxh3_128_digest(g[e - c : e].tobytes()) if c else None for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
            bands = pa.FixedSizeListArray.from_arrays(pa.array(pairs.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(digest, pa.binary()), bands], names=["doc_id", "n", "digest", "bands"])


class PutBack:
    """Tokens that go to the end of the order."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens.astype(np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.tokens >> np.uint64(TOKEN_BITS - 20)).astype(np.int64)] = True

    def has(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), bool)
        if len(self.tokens):
            at = np.flatnonzero(self.seen[(g >> np.uint64(TOKEN_BITS - 20)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.tokens, g[at]), len(self.tokens) - 1)
            out[at] = self.tokens[k] == g[at]
        return out


def _ranked(g: np.ndarray, count: np.ndarray, back: PutBack, percent: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's tokens: document, whether put back, rank in the document's order, whether it is posted."""
    doc = np.repeat(np.arange(len(count)), count)
    late = back.has(g)
    before = np.concatenate(([0], np.cumsum(late)))
    first = np.cumsum(count) - count
    late_before = before[:-1] - np.repeat(before[first] if len(g) else first, count)
    place = np.arange(len(g)) - np.repeat(first, count)
    early = count - np.bincount(doc, weights=late, minlength=len(count)).astype(np.int64)
    rank = np.where(late, early[doc] + late_before, place - late_before)
    posts = count - -(-count * percent // 100) + 1
    return doc, late, rank, rank < posts[doc]


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, back: PutBack) -> Iterator[pa.RecordBatch]:
    """piece, text, class -> postings: token, piece, class, and size and lateness in one number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, class_ = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for lo, hi, offs, data in chunks(batch.column(1)):
            g, count = token_sets(offs, data, n)
            doc, late, _, mine = _ranked(g, count, back, percent)
            doc, late = doc[mine], late[mine]
            packed = (count[doc] << 32) | late
            yield pa.RecordBatch.from_arrays([pa.array(g[mine].view(np.int64)), pa.array(piece[lo:hi][doc]), pa.array(class_[lo:hi][doc]), pa.array(packed)], names=["token", "piece", "class", "packed"])


def _around(batches: Iterator[pa.RecordBatch], n: int, percent: int, heavy: PutBack) -> Iterator[pa.RecordBatch]:
    """All tokens, with their classes, of documents that post a heavy token."""
    none = PutBack(np.zeros(0, np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        class_ = batch.column(2).to_numpy()
        for lo, hi, offs, data in chunks(batch.column(1)):
            g, count = token_sets(offs, data, n)
            doc, _, _, mine = _ranked(g, count, none, percent)
            hit = np.zeros(hi - lo, bool)
            hit[doc[mine][heavy.has(g[mine])]] = True
            take = hit[doc]
            yield pa.RecordBatch.from_arrays([pa.array(g[take].view(np.int64)), pa.array(class_[lo:hi][doc[take]])], names=["token", "class"])


def _bounds(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of postings (size above, lateness below) of one token: whether the sizes leave room for a link, and how
    many posted tokens a link shares at least: beyond the shorter prefix lie as many tokens as the longer rest has."""
    sx, sy = x >> 32, y >> 32
    overlap = -(-percent * (sx + sy) // (100 + percent))
    rest = np.maximum(-(-sx * percent // 100), -(-sy * percent // 100)) - 1
    return 100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy), np.maximum(1, overlap - rest)


def _once(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, the smaller piece first, with its least need."""
    order = np.lexsort((need, np.maximum(a, b), np.minimum(a, b)))
    a, b, need = np.minimum(a, b)[order], np.maximum(a, b)[order], need[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], need[new]


def _pairs(p: np.ndarray, c: np.ndarray, packed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of pieces that postings of one token allow: other class, sizes that leave room for a link."""
    order = np.argsort(packed >> 32, kind="stable")
    p, c, packed = p[order], c[order], packed[order]
    size = packed >> 32
    low = np.searchsorted(100 * size, percent * size, "left")  # the smallest size that a link allows
    spans = np.arange(len(p)) - low
    out = [(np.zeros(0, np.int64),) * 3]
    step = max(1, int(2_000_000 // max(1, spans.max(initial=1))))
    for s in range(0, len(p), step):  # some postings at a time bound the arrays
        k = np.arange(s, min(len(p), s + step))
        i = np.repeat(k, spans[k])
        j = np.arange(len(i)) - np.repeat(np.cumsum(spans[k]) - spans[k], spans[k]) + low[i]
        room, need = _bounds(packed[i], packed[j], percent)
        good = (c[i] != c[j]) & (p[i] != p[j]) & room
        out.append((p[i[good]], p[j[good]], need[good]))
    return _once(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _neighbours(p: np.ndarray, c: np.ndarray, packed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of those pairs, the ones that follow each other in order of size."""
    order = np.argsort(packed >> 32, kind="stable")
    p, c, packed = p[order], c[order], packed[order]
    room, need = _bounds(packed[:-1], packed[1:], percent)
    good = (c[:-1] != c[1:]) & (p[:-1] != p[1:]) & room
    return _once(p[:-1][good], p[1:][good], need[good])


def _meet(batches: Iterator[pa.RecordBatch], every: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token: pairs of pieces, every one or those of neighbours by size only."""
    held: list[tuple] = []
    token = None

    def flush(out: tuple[list, list, list]) -> None:
        p, c, packed = (np.concatenate(x) for x in zip(*held, strict=True))
        if (c == c[0]).all():
            return
        for to, x in zip(out, (_pairs if every else _neighbours)(p, c, packed, percent), strict=True):
            to.append(x)

    def rows(out: tuple[list, list, list]) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in out], names=["a", "b", "need"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t, p, c, packed = (batch.column(i).to_numpy() for i in range(4))
        cut = np.flatnonzero(np.diff(t)) + 1
        starts, ends = np.concatenate(([0], cut)), np.append(cut, len(t))
        # Most tokens are posted within one class; only the others, and what touches the batch's ends, are looked at.
        busy = np.flatnonzero(np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts))
        # Tokens with two postings, by far the most of these, are looked at all at once.
        two = busy[(ends[busy] - starts[busy] == 2) & (busy > 0) & (busy < len(starts) - 1)]
        i, j = starts[two], starts[two] + 1
        room, need = _bounds(packed[i], packed[j], percent)
        good = room & (p[i] != p[j])
        # One row for each token that a pair shares: they are counted.
        out: tuple[list, list, list] = ([np.minimum(p[i[good]], p[j[good]])], [np.maximum(p[i[good]], p[j[good]])], [need[good]])
        for k in np.union1d(np.setdiff1d(busy, two), [0, len(starts) - 1]).tolist():
            s, e = starts[k], ends[k]
            if held and t[s] != token:
                flush(out)
                held = []
            token = t[s]
            held.append((p[s:e], c[s:e], packed[s:e]))
        yield rows(out)
    if held:
        out = ([], [], [])
        flush(out)
        yield rows(out)


def _blobs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """node, piece, text, sorted by piece -> pieces: members, their sizes, the token union, the members' tokens as bits over it."""
    held: tuple[int, list, list, list] | None = None

    def close(piece: int, ids: list, sizes: list, tokens: list) -> tuple:
        g, count = np.concatenate(tokens), np.concatenate(sizes)
        ids = np.concatenate(ids)
        if len(ids) == 1:
            return piece, ids.tolist(), count.tolist(), g.tobytes(), np.packbits(np.ones(len(g), bool)).tobytes()
        union, where = np.unique(g, return_inverse=True)
        bits, at = np.zeros((len(ids), -(-len(union) // 8)), np.uint8), 0
        for row, n in zip(bits, count.tolist(), strict=True):
            of = where[at : at + n]  # distinct and sorted
            np.bitwise_or.at(row, of >> 3, (128 >> (of & 7)).astype(np.uint8))
            at += n
        return piece, ids.tolist(), count.tolist(), union.tobytes(), bits.tobytes()

    def out(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [()] * 5
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["piece", "ids", "sizes", "union", "bits"])

    for batch in batches:
        node, piece = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, offs, data in chunks(batch.column(2)):
            done = []
            g, count = token_sets(offs, data, n)
            ends = np.concatenate(([0], np.cumsum(count)))
            cut = np.flatnonzero(np.diff(piece[lo:hi])) + 1
            for s, e in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, hi - lo).tolist(), strict=True):
                if held is not None and held[0] != piece[lo + s]:
                    done.append(close(*held))
                    held = None
                if held is None:
                    held = (int(piece[lo + s]), [], [], [])
                held[1].append(node[lo + s : lo + e])
                held[2].append(count[s:e])
                held[3].append(g[ends[s] : ends[e]])
            yield out(done)
    if held is not None:
        yield out([close(*held)])


BLOB = "piece long, ids array<long>, sizes array<long>, `union` binary, bits binary"


class Piece:
    """A piece as stored: members, their sizes, the token union, a bit for each member and token."""

    def __init__(self, ids: pa.Scalar, sizes: pa.Scalar, union: pa.Scalar, bits: pa.Scalar):
        self.ids, self.sizes = np.array(ids.as_py(), np.int64), np.array(sizes.as_py(), np.int64)
        self.union = np.frombuffer(union.as_py(), np.uint64)
        self.bits = np.frombuffer(bits.as_py(), np.uint8).reshape(len(self.ids), -1)

    def columns(self, at: np.ndarray, members: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of the members have the tokens at these places of the union."""
        return (self.bits[members][:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _shares(x: Piece, y: Piece, in_x: np.ndarray, in_y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> np.ndarray:
    """Tokens that members of_x of x share with members of_y of y. in_x, in_y: places of the common tokens in the unions."""
    both = np.zeros((len(of_x), len(of_y)), np.int64)
    for s in range(0, len(in_x), COLUMNS):
        a, b = x.columns(in_x[s : s + COLUMNS], of_x), y.columns(in_y[s : s + COLUMNS], of_y)
        both += (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    return both


def _covered(x: Piece, at: np.ndarray) -> np.ndarray:
    """Tokens of each member at these places of the union."""
    return sum((x.columns(at[s : s + COLUMNS]).sum(1, dtype=np.int64) for s in range(0, len(at), COLUMNS)), np.zeros(len(x.ids), np.int64))


def _within(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links within a piece."""
    label = np.arange(len(ids))
    while True:
        least = np.where(linked, label[None, :], len(ids)).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(ids)))
    return ids[off], ids[label[off]]


def links(x: Piece, y: Piece | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between pieces x and y, enough to connect what is linked; with y None, within x."""
    if y is None:
        every, members = np.arange(len(x.union)), np.arange(len(x.ids))
        both = _shares(x, x, every, every, members, members)
        linked = 100 * both >= percent * (x.sizes[:, None] + x.sizes[None, :] - both)
        return _within(linked & (x.sizes[:, None] > 0), x.ids)
    xi, xs, yi, ys = x.ids, x.sizes, y.ids, y.sizes
    at = np.minimum(np.searchsorted(y.union, x.union), max(0, len(y.union) - 1))
    in_x = np.flatnonzero(y.union[at] == x.union) if len(y.union) else np.zeros(0, np.int64)
    if not len(in_x):
        return xi[:0], xi[:0]
    in_y = at[in_x]
    # The bound: a link of a set of n tokens shares at least ceil(n * percent / 100) with the other, so with its union.
    open_x = np.flatnonzero(100 * _covered(x, in_x) >= percent * xs)
    open_y = np.flatnonzero(100 * _covered(y, in_y) >= percent * ys)
    if not len(open_x) or not len(open_y):
        return xi[:0], xi[:0]
    both = _shares(x, y, in_x, in_y, open_x, open_y)
    linked = 100 * both >= percent * (xs[open_x][:, None] + ys[open_y][None, :] - both)
    r, c = np.nonzero(linked)
    # Each member of either side keeps its first link, and each connected part keeps its own: a spanning forest.
    m = len(open_x)
    label = np.arange(m + len(open_y))
    keep = np.zeros(len(r), bool)

    def top(v: int) -> int:
        while label[v] != v:
            label[v] = label[label[v]]
            v = label[v]
        return v

    for k, (p, q) in enumerate(zip(r.tolist(), (c + m).tolist(), strict=True)):
        p, q = top(p), top(q)
        if p != q:
            label[max(p, q)] = min(p, q)
            keep[k] = True
    return xi[open_x[r[keep]]], yi[open_y[c[keep]]]


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(batch.num_rows):
            x = Piece(*(batch.column(i)[k] for i in range(4)))
            y = Piece(*(batch.column(i)[k] for i in range(4, 8))) if batch.column(4)[k].is_valid else None
            p, q = links(x, y, percent)
            a.append(p)
            b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.cut(rows.mapInArrow(lambda b: _sketches(b, n), "doc_id long, n long, digest binary, bands array<long>"), "sets")
    repeats = sets.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("c > 1")
    has_repeats, has_variants = repeats.agg(F.count(F.lit(1)) > 0, F.coalesce(F.max(F.col("x") != F.col("y")), F.lit(False))).first()
    if has_variants:
        return _of_variants(rows, scratch, n, percent)
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    # Group by the first pair of minima; a large group is dealt into pieces by hash. Only large groups are looked up, so no group moves as one.
    nodes = scratch.cut(nodes.groupBy("node").agg(F.first("bands").alias("bands"), F.min("n").alias("least"), F.max("n").alias("most")), "nodes")
    first = F.col("bands")[0]
    large = scratch.cut(nodes.groupBy(first.alias("g")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > PIECE), "large")
    placed = nodes.join(small(large, large.count()), first == F.col("g"), "left")
    deal = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(PIECE))), F.lit(0))
    placed = scratch.cut(placed.select("node", "bands", "least", "most", F.xxhash64(first, deal).alias("piece")), "placed")

    # Linear joins: within pieces of several members, and of each piece with the first that shares a pair of minima.
    span = placed.groupBy("piece").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("members"))
    seen = placed.select("piece", F.explode("bands").alias("band")).distinct().join(span, "piece").select("band", F.struct("piece", "least", "most").alias("p"))
    lead = seen.groupBy("band").agg(F.min("p").alias("lead"), F.max("p.piece").alias("last")).where("lead.piece <> last").select(F.col("band").alias("_band"), "lead")
    fits = f"p.piece <> lead.piece AND 100 * p.most >= {percent} * lead.least AND 100 * lead.most >= {percent} * p.least"
    near = seen.join(lead, F.col("band") == F.col("_band")).where(fits).select(F.col("p.piece").alias("a"), F.col("lead.piece").alias("b")).distinct()
    within = span.where("members > 1").select(F.col("piece").alias("a"), F.lit(None).cast("long").alias("b"))
    near = scratch.cut(near.unionByName(within), "near")

    def verify(pairs: DataFrame, tag: str) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("piece")).where("piece is not null").distinct()
        members = scratch.cut(placed.select("node", "piece").join(needed, "piece", "left_semi"), f"{tag}members")
        count = members.count()
        texts = rows.join(small(members, count), F.col("doc_id") == F.col("node")).select("node", "piece", "text")
        if has_repeats:  # one text for each node
            texts = texts.groupBy("node").agg(F.first("piece").alias("piece"), F.min("text").alias("text"))
        blobs = scratch.cut(texts.repartition("piece").sortWithinPartitions("piece", "node").mapInArrow(lambda b: _blobs(b, n), BLOB), f"{tag}blobs")
        left = pairs.join(blobs.withColumnRenamed("piece", "a"), "a").select("b", *[F.col(c).alias(f"x_{c}") for c in ("ids", "sizes", "union", "bits")])
        right = blobs.select(F.col("piece").alias("b"), *[F.col(c).alias(f"y_{c}") for c in ("ids", "sizes", "union", "bits")])
        both = left.join(right, "b", "left").drop("b")
        found = scratch.cut(both.mapInArrow(lambda b: _verify(b, percent), "a long, b long"), f"{tag}links")
        scratch.drop(f"{tag}blobs", f"{tag}members")
        return found

    found = verify(near, "near")
    class_of = scratch.cut(components(found, scratch, "first"), "classes")

    # The rest: postings of pieces. First neighbours in a posting meet, which is linear and joins most classes that
    # belong together; then all that are still of different classes.
    def members_of(class_of: DataFrame, tag: str) -> DataFrame:
        named = class_of.withColumnRenamed("node", "_node")
        member = placed.select("node", "piece").join(named, F.col("node") == F.col("_node"), "left")
        member = scratch.cut(member.select(F.col("node").alias("_id"), "piece", F.coalesce("component", "node").alias("class")), tag)
        return rows.join(member, F.col("doc_id") == F.col("_id")).select("piece", "text", "class")

    held = members_of(class_of, "member")

    def meet(held: DataFrame, back: PutBack, every: bool, tag: str) -> tuple[DataFrame, DataFrame | None]:
        """Pairs of pieces that share posted tokens. Without every: of neighbours only, and tokens of more than FEW classes are left
        out and returned with their classes. Only postings of tokens with several classes move to meet."""
        shared = spark.sparkContext.broadcast(back)
        posted = scratch.cut(held.mapInArrow(lambda b: _prefixes(b, n, percent, shared.value), "token long, piece long, class long, packed long"), f"{tag}posted")
        mixed = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("token", "c")
        mixed = scratch.cut(mixed, f"{tag}mixed")
        heavy = None
        if not every:
            busy = mixed.where(F.col("c") > FEW).select("token")
            of = posted.join(small(busy, busy.count()), "token", "left_semi").groupBy("token", "class").agg(F.lit(1).alias("x"))
            heavy = scratch.cut(of.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FEW), f"{tag}heavy")
            mixed = mixed.join(small(heavy.select("token"), heavy.count()), "token", "left_anti")
        # Tokens with several classes grow with the corpus, so they are never sent to all.
        some = posted.join(mixed.select("token").hint("shuffle_hash"), "token", "left_semi")
        met = some.repartition("token").sortWithinPartitions("token").mapInArrow(lambda b: _meet(b, every, percent), "a long, b long, need long")
        met = scratch.cut(met, tag)
        scratch.drop(f"{tag}posted", f"{tag}mixed")
        return met, heavy

    def most_held(df: DataFrame) -> np.ndarray:
        """The tokens, those of the most classes if they are more than PUT_BACK."""
        if df.count() > PUT_BACK:
            df = df.orderBy(F.desc("c"), "token").limit(PUT_BACK)
        return np.array([r[0] for r in df.select("token").toLocalIterator()], np.int64).view(np.uint64)

    def counted(met: DataFrame, share: int) -> DataFrame:
        """Pairs of pieces that share as many posted tokens as a link must (one in share of them, where not all meet)."""
        pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
        return pairs.where(F.col("shared") * share >= F.col("need")).select("a", "b")

    met, heavy = meet(held, PutBack(np.zeros(0, np.uint64)), False, "met0")
    back = most_held(heavy)
    if len(back):
        # Other tokens of the documents that post heavy ones may be as heavy: those of many classes go back too.
        shared = spark.sparkContext.broadcast(PutBack(back))
        some = held.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(LOOK_IN)) == 0)
        around = some.mapInArrow(lambda b: _around(b, n, percent, shared.value), "token long, class long")
        more = around.groupBy("token", "class").agg(F.lit(1).alias("x")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        back = np.concatenate((back, most_held(scratch.cut(more.where(F.col("c") > FEW // LOOK_IN), "around"))))
    tried = scratch.cut(counted(met, 4), "tried")
    scratch.drop("met0", "around")
    star = lambda c: c.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    def between(links: DataFrame, class_of: DataFrame) -> DataFrame:
        """The links as links of classes, each once."""
        for c in ("a", "b"):
            of = class_of.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_c{c}"))
            links = links.join(of, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_c{c}", c)).drop(f"_{c}", f"_c{c}")
        return links.where("a <> b").distinct()

    joined = scratch.cut(components(star(class_of).unionByName(between(verify(tried, "tried"), class_of)), scratch, "second"), "classes2")
    held = members_of(joined, "member2")
    met, _ = meet(held, PutBack(back), True, "met1")
    pairs = counted(met, 1).join(tried.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    rest = verify(scratch.cut(pairs, "pairs"), "rest")
    final = components(star(joined).unionByName(between(rest, joined)), scratch, "last")

    reps = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node")).join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return sets.join(reps, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _of_variants(rows: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """classes, where a doc_id has different texts: each row is a node, and the classes of a doc_id's rows are merged at the end."""
    row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = scratch.cut(rows.withColumn("row", row), "rows")
    found = classes(rows.select(F.col("row").alias("doc_id"), "text"), n, percent)
    found = scratch.cut(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("class")), "found")
    # Rows without an id have no node; they stand in the class of an equal set, if there is one.
    own = found.join(rows.select("row", "doc_id"), "row")
    linked = own.where("n_shingles > 0")
    lead = linked.groupBy("doc_id").agg(F.min("class").alias("b"))
    links = linked.join(lead, "doc_id").select(F.col("class").alias("a"), "b").where("a <> b").distinct()
    whole = components(links, scratch, "variants")
    named = lambda df: df.join(whole, F.col("class") == F.col("node"), "left").withColumn("class", F.coalesce("component", "class")).drop("node", "component")
    least = named(linked).groupBy("class").agg(F.min("doc_id").alias("component_id"))
    shown = own.unionByName(found.where("row is null").withColumn("doc_id", F.lit(None).cast("long")))
    out = named(shown).join(least, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the smallest doc_id, by words of five and 0.8.

    A row is a document by its doc_id and text, named by a 64-bit hash of both: texts that share an id, or have none, are
    documents of their own. A null doc_id is larger than any; of equal ids the smaller hash stays. Rows that agree in
    doc_id and text are one document, of which one row stays, any of them where they differ in other columns. Documents
    without words are linked with nothing, so each of them stays.
    """
    key, kept, rows_, id_, class_ = fresh(docs, "row_key", "kept_key", "rows", "id", "class")
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    found = classes(rows.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    scratch = Scratch(docs.sparkSession, "one_of_each")
    ids = rows.groupBy(F.col(key).alias(kept)).agg(F.first(F.col("doc_id").cast("long")).alias(id_), F.count(F.lit(1)).alias(rows_))
    of = found.groupBy(F.col("doc_id").alias(key)).agg(F.first("component_id").alias(class_))
    each = ids.join(of, F.col(kept) == F.col(key)).select(kept, id_, rows_, class_)
    first = F.min(F.struct(F.col(id_).isNull(), F.col(id_), F.col(kept), F.col(rows_))).alias("x")
    chosen = scratch.cut(each.groupBy(class_).agg(first).select(f"x.{kept}", f"x.{rows_}"), "chosen")
    n, repeated = chosen.agg(F.count(F.lit(1)), F.count(F.when(F.col(rows_) > 1, 1))).first()
    once = rows.join(small(chosen.where(F.col(rows_) == 1).select(kept), n), F.col(key) == F.col(kept), "left_semi").drop(key)
    if not repeated:
        return once
    several = rows.join(small(chosen.where(F.col(rows_) > 1).select(kept), repeated), F.col(key) == F.col(kept), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Equal rows fall together where they are read; what moves is one row for each batch of a task.
    single = several.groupBy(key).agg(F.first(F.struct(*columns)).alias(kept)).select(f"`{kept}`.*")
    return once.unionByName(single)
