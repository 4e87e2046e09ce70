"""Substring dedup by seed and extend on winnowed anchors.

A window is WINDOW consecutive words of a document. Of its k-grams the one with the least hash (the first of
equals) is its anchor, so windows with the same words have the same anchor at the same place. Neighbouring
windows mostly share their anchor; such a run, extended both ways to all words that its windows cover, is a
span. Documents are joined on anchors:

1. An anchor that occurs once in the corpus starts no repeat and goes.
2. Spans with the same words repeat whole: all but the first place, by (doc_id, start), are repeats.
3. Where the same anchor has spans with different words (the ends of a repeat), the first place of each span
   is extended window by window: its windows are joined on their words, and all but the first place repeat.

Neighbouring repeats merge to maximal ones, and their words are removed. All decisions look at the input.
Places that agree within one batch are decided there, so a passage in a third of all documents moves one row for
each batch and not one for each document; no group is collected.

Defined cases: a null or wordless text has 0 words and the hash of the empty string; a document shorter than a
window loses nothing; a document is a doc_id with a text: rows that agree in both are one document and have equal results,
texts that share a doc_id are documents of their own, in order of the texts' hashes (column sub, 0 where an id has one text);
a null doc_id sorts first and is otherwise an id like others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small
from .kernels import BYTE_VALUES, NOT_SPACE, Words, chunks, grams, mix, powers, valid, words

WINDOW = 20
K = 7
#: Kinds of rows: a place that others must be compared with, a sure repeat, a place to be extended window by window.
PROBE, REPEAT, EDGE = 0, 1, 2
NULL_ID = -(1 << 63)
PLACES = "kind int, anchor long, span long, doc long, sub long, start int, n int"


def runs(w: Words) -> tuple[np.ndarray, ...]:
    """Of a chunk's windows, grouped by document and anchor: document, first window, windows, anchor hash, span hash."""
    h = w.hashes()
    inside = np.flatnonzero(valid(w.doc, WINDOW))
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    g = grams(h, K)
    per = WINDOW - K + 1
    anchor = np.lib.stride_tricks.sliding_window_view(g, per)[inside].argmin(1) + inside
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (w.doc[inside[1:]] != w.doc[inside[:-1]])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(inside)))
    first = inside[at]
    # Hash of the span's words by sums of each word's hash times a power of its place from the span's start.
    p, inverse = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    last = first + n - 1 + WINDOW
    span = mix((sums[last] - sums[first]) * inverse[first] + n.astype(np.uint64))
    doc = w.doc[first]
    return doc, first - w.first[doc], n, g[anchor[at]], span


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the second and so on; equal keys stay as they are."""
    return np.lexsort(keys[::-1])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before in any key; the first does."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    """A batch of the columns, with names and types as in a schema."""
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype({"int": np.int32, "long": np.int64}[t])) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, sub, text -> places of the batch, each once."""
    for batch in batches:
        ids, subs, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        for lo, hi, offs, data in chunks(batch.column(2)):
            doc, start, n, anchor, span = runs(words(offs, data, NOT_SPACE, BYTE_VALUES))
            parts.append((ids[lo:hi][doc], subs[lo:hi][doc], start, n, anchor.astype(np.uint64), span.astype(np.uint64)))
        if not parts:
            continue
        doc, sub, start, n, anchor, span = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _order(anchor, span, doc, sub, start)
        doc, sub, start, n, anchor, span = (x[order] for x in (doc, sub, start, n, anchor, span))
        new_anchor, new_span = _changes(anchor), _changes(anchor, span)
        kind = np.where(new_span, PROBE, REPEAT)
        # Rows of one document at one start are the same place: not a repeat of each other.
        keep = _changes(anchor, span, doc, sub, start)
        # Where the batch has several spans of an anchor, all are edges; two of them stand for the anchor elsewhere.
        group = np.cumsum(new_anchor) - 1
        spans = np.bincount(group, weights=new_span, minlength=group[-1] + 1 if len(group) else 0)
        many = spans[group] > 1
        extra = new_span & many
        rank = np.cumsum(new_span) - np.cumsum(new_span)[np.flatnonzero(new_anchor)][group] if len(group) else group
        rows = keep & (~new_span | ~extra | (rank < 2))
        kinds = np.concatenate((kind[rows], np.full(extra.sum(), EDGE)))
        yield _batch(PLACES, kinds, *(np.concatenate((x[rows], x[extra])) for x in (anchor.view(np.int64), span.view(np.int64), doc, sub, start, n)))


FOUND = "kind int, doc long, sub long, start int, n int"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes sorted by anchor, span, document and start: repeats of spans, and edges of anchors with several spans."""
    held: list | None = None  # the last row of an anchor: [anchor, span, place, whether it is an edge already]
    for batch in batches:
        if not batch.num_rows:
            continue
        a, s, *place = (batch.column(i).to_numpy() for i in range(1, 7))
        new_a, new_s = _changes(a), _changes(a, s)
        follows = held is not None and held[0] == a[0]
        new_a[0] = not follows
        new_s[0] = not (follows and held[1] == s[0])
        # First places of spans, with the one held from the batch before put first where it goes on.
        firsts = np.flatnonzero(new_s)
        group = np.cumsum(new_a)
        in_group = np.bincount(group[firsts], minlength=group[-1] + 1) if len(firsts) else np.zeros(group[-1] + 1)
        if follows:
            in_group[0] += 2 if held[3] else 1
        edge = firsts[in_group[group[firsts]] > 1]
        rows = [(np.full(len(edge), EDGE), *(x[edge] for x in place))]
        repeat = np.flatnonzero(~new_s)
        previous = np.maximum.accumulate(np.where(new_s, np.arange(len(a)), -1))[repeat]
        other = np.zeros(len(repeat), bool)
        for i, x in enumerate(place[:3]):
            other |= np.where(previous < 0, held[2][i] if held else 0, x[previous]) != x[repeat]
        repeat = repeat[other]
        rows.append((np.full(len(repeat), REPEAT), *(x[repeat] for x in place)))
        if follows and not held[3] and len(firsts) and group[firsts[0]] == 0:
            rows.append((np.array([EDGE]), *(np.array([x]) for x in held[2])))
            held[3] = True
        if len(firsts):
            f = firsts[-1]
            # Either still the held anchor, or one that begins here.
            held = [a[-1], s[-1], tuple(x[f] for x in place), True if group[-1] == 0 else bool(in_group[group[f]] > 1)]
        yield _batch(FOUND, *(np.concatenate(x) for x in zip(*rows, strict=True)))


WINDOWS = "kind int, window long, doc long, sub long, start int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, sub, text, edges (array of start, n): hashes of the edges' windows, and repeats that the batch itself shows."""
    for batch in batches:
        ids, subs, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        edges = batch.column(3)
        for lo, hi, offs, data in chunks(batch.column(2)):
            w = words(offs, data, NOT_SPACE, BYTE_VALUES)
            g = grams(w.hashes(), WINDOW)
            e = edges.slice(lo, hi - lo)
            sizes = np.diff(e.offsets.to_numpy())
            flat = e.flatten()
            start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            owner = np.repeat(np.repeat(np.arange(hi - lo), sizes), n)
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parts.append((g[w.first[owner] + at], ids[lo:hi][owner], subs[lo:hi][owner], at))
        if not parts:
            continue
        h, doc, sub, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _order(h, doc, sub, at)
        h, doc, sub, at = h[order], doc[order], sub[order], at[order]
        new, once = _changes(h), _changes(h, doc, sub, at)
        yield _batch(WINDOWS, np.where(new, PROBE, REPEAT)[once], h.view(np.int64)[once], doc[once], sub[once], at[once])


RUNS = "doc long, sub long, start int, n int"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes sorted by window, document and start: all but the first place of each window."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, *place = (batch.column(i).to_numpy() for i in range(1, 5))
        new = _changes(h)
        if last is not None and h[0] == last[0]:
            new[0] = False
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        firsts = [np.where(first < 0, last[1 + i] if last else 0, x[first]) for i, x in enumerate(place)]
        last = (h[-1], *(x[-1] for x in firsts))
        later = np.flatnonzero(~new & np.logical_or.reduce([x != y for x, y in zip(firsts, place, strict=True)]))
        yield _batch(RUNS, *(x[later] for x in place), np.ones(len(later)))


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, sub, start, n: runs of windows that also start earlier. docs: doc (long), sub (long), text."""
    key, run = ["doc", "sub"], ["doc", "sub", "start", "n"]
    places = scratch.cut(docs.select(*key, "text").mapInArrow(_places, PLACES), "places")
    probes = places.where(F.col("kind") == PROBE).repartition("anchor").sortWithinPartitions("anchor", "span", *key, "start")
    found = scratch.cut(probes.mapInArrow(_joined, FOUND), "found")
    edges = found.where(F.col("kind") == EDGE).select(*run).unionByName(places.where(F.col("kind") == EDGE).select(*run))
    by_doc = edges.groupBy(*key).agg(F.collect_set(F.struct("start", "n")).alias("edges"))
    texts = docs.select(*key, "text").join(by_doc, key).select(*key, "text", "edges")
    windows = scratch.cut(texts.mapInArrow(_windows, WINDOWS), "windows")
    later = windows.where(F.col("kind") == PROBE).repartition("window").sortWithinPartitions("window", *key, "start").mapInArrow(_later, RUNS)
    out = found.where(F.col("kind") == REPEAT).select(*run)
    for more in (places.where(F.col("kind") == REPEAT).select(*run), windows.where(F.col("kind") == REPEAT).select(*key, "start", F.lit(1).alias("n")), later):
        out = out.unionByName(more)
    return out


def _cleaned(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, hashes, texts = [], [], [], []
        runs_of = batch.column(2)
        for lo, hi, offs, data in chunks(batch.column(1)):
            w = words(offs, data, NOT_SPACE, BYTE_VALUES)
            e = runs_of.slice(lo, hi - lo).fill_null([])
            sizes = np.diff(e.offsets.to_numpy())
            flat = e.flatten()
            start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            base = w.first[np.repeat(np.arange(hi - lo), sizes)] if len(sizes) else start
            limit = base + w.count[np.repeat(np.arange(hi - lo), sizes)] if len(sizes) else start
            marks = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(marks, np.minimum(base + start, limit), 1)
            np.add.at(marks, np.minimum(base + start + n - 1 + WINDOW, limit), -1)
            gone = np.cumsum(marks)[:-1] > 0
            raw = data.tobytes()
            for d in range(hi - lo):
                a, b = int(w.first[d]), int(w.first[d] + w.count[d])
                if gone[a:b].any():
                    kept = np.flatnonzero(~gone[a:b]) + a
                    text = b" ".join([raw[s:t] for s, t in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)])
                else:
                    text = b" ".join(raw[offs[d] : offs[d + 1]].split())
                counts.append(b - a)
                removed.append(int(gone[a:b].sum()))
                hashes.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())]
        yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.string())] if with_text else []), names=["doc", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)


def named(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, sub, text of docs' rows: sub is 0 where all rows of an id have one text, else the text's hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    several = rows.groupBy("doc").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select(F.col("doc").alias("_doc"))
    several = scratch.cut(several, "several")
    n = several.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("long").alias("sub"), "text")
    return rows.join(small(several, n), F.col("doc") == F.col("_doc"), "left").select("doc", F.when(F.col("_doc").isNull(), F.lit(0)).otherwise(h).cast("long").alias("sub"), "text")


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept, the text that is left, of each row of docs."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = named(docs, scratch)
    of = repeats(rows, scratch).groupBy("doc", "sub").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = rows.join(of, ["doc", "sub"], "left").select("doc", "text", "runs")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    out = joined.mapInArrow(lambda b: _cleaned(b, with_text), schema)
    return out.withColumn("doc", F.when(F.col("doc") != NULL_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_text=False)
