"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text's words become three bucket numbers each: of the word, of its first four bytes and of its first five.
A word's vector is the sum of the three embeddings. Filters of widths 1, 2 and 3 run over the
vectors, each filter's largest response over the whole text is kept (max pooling), and a logistic layer gives
the chance of label 1. Embeddings start from the training labels: their first component is the bucket's
smoothed log odds, the others are random. Adam trains all layers; the gradient of max pooling reaches
only the words that won. Thresholds are set by language on a part of the training rows that the network
did not see, and scores are bent so that the language's threshold comes out as 0.3. The language is
guessed from the text's function words; the column lang is not read.

Training rows are bounded: TRAIN_ROWS labelled documents and TRAIN_WORDS words at most on average of a draw by hashes of id and
text, equal rows once, texts of more than LONG words not among them; their encoded words come to the driver.
Scoring is a map over all whole texts, without a shuffle.

Defined cases: a null or wordless text scores as a text with no response (the pooled vector is zero);
a doc_id that is null is held out of training; labels that are null are ignored; of several labels of one
document the largest counts; without labels of both kinds every score is 0; an empty table gives an
empty one; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh
from .kernels import LETTERS, LOWER_VALUES, chunks, words

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled documents that the network is trained on, at most (on average of the draw by hash).
TRAIN_ROWS = 6000
#: Words of all training texts together (on average of the draw), and of one of them, at most.
TRAIN_WORDS, LONG = 4_000_000, 50_000
#: Passes over the training rows at least, and steps (of 64 rows) at least.
EPOCHS, STEPS = 6, 1200
CUT = 0.3
#: Function words by language.
LANGUAGES = {
    "en": "the of and to in is that it for on with as was are be this",
    "fr": "le la les des et un une du que qui est dans pour sur par au",
    "de": "der die das und ist nicht ein eine zu von mit den dem im für auf",
    "es": "el los las y que es un una del se por con para no en su",
}


def hash_words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (words x 3), words of each document, and the words' hashes."""
    w = words(offs, data, LETTERS, LOWER_VALUES)
    h = w.hashes()
    ids = np.empty((len(h), 3), np.int32)
    for c, x in enumerate((h, w.hashes(most=4) ^ np.uint64(1), w.hashes(most=5) ^ np.uint64(2))):
        ids[:, c] = (x % np.uint64(BUCKETS)).astype(np.int32)
    return ids, w.count, h


def _language_hashes() -> tuple[np.ndarray, np.ndarray]:
    text = "\n".join(LANGUAGES.values()).encode()
    offs = np.concatenate(([0], np.cumsum([len(x.encode()) + 1 for x in LANGUAGES.values()])))
    offs[-1] -= 1
    _, count, h = hash_words(offs, np.frombuffer(text, np.uint8))
    owner = np.repeat(np.arange(len(LANGUAGES)), count)
    order = np.argsort(h, kind="stable")
    return h[order], owner[order]


def languages(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The language of each document by its function words; the first of the list if none is there."""
    known, owner = _language_hashes()
    doc = np.repeat(np.arange(len(count)), count)
    votes = np.zeros((len(count), len(LANGUAGES)))
    for shift in range(3):  # a word may stand in several lists
        at = np.minimum(np.searchsorted(known, h, "left") + shift, len(known) - 1)
        hit = known[at] == h
        np.add.at(votes, (doc[hit], owner[at[hit]]), 1)
    return votes.argmax(1)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.e[:, 0] = 0
        self.w = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:
            w[:, 0, :] = np.abs(w[:, 0, :]) + 0.3
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.float32(-1)
        self.thresholds = np.full(len(LANGUAGES), 0.5)
        self.known = True

    def pool(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest positive response of each filter in each document (0 if none), and the word where it starts (-1)."""
        docs = len(count)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        top = np.zeros((docs, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(top.shape, -1, np.int64)
        if not len(ids):
            return top, where
        x = self.e[ids[:, 0]] + self.e[ids[:, 1]] + self.e[ids[:, 2]]
        for c, (k, w, b) in enumerate(zip(WIDTHS, self.w, self.b, strict=True)):
            n = len(x) - k + 1
            some = np.flatnonzero(count >= k)
            if n <= 0 or not len(some):
                continue
            r = x[:n] @ w[0]
            for j in range(1, k):
                r += x[j : j + n] @ w[j]
            r += b
            if k > 1:  # runs that reach into the next document don't count
                ends = first[some] + count[some] - k + 1
                for j in range(k - 1):
                    cut = ends + j
                    r[cut[cut < n]] = -1e9
                short = np.flatnonzero((count > 0) & (count < k))
                for d in short:
                    r[first[d] : min(n, first[d] + count[d])] = -1e9
            starts = first[some]
            best = np.maximum.reduceat(r, starts, axis=0) if len(some) else r[:0]
            cols = slice(c * FILTERS, (c + 1) * FILTERS)
            top[some, cols] = np.maximum(best, 0)
            if self.training:
                for d, s, m in zip(some.tolist(), starts.tolist(), count[some].tolist(), strict=True):
                    where[d, cols] = s + r[s : s + m - k + 1].argmax(0)
        return top, np.where(top > 0, where, -1)

    training = False

    def chance(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        top, _ = self.pool(ids, count)
        return 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -30, 30).astype(np.float64)))

    def bend(self, p: np.ndarray, language: np.ndarray) -> np.ndarray:
        t = self.thresholds[language]
        return np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t))

    def score(self, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
        ids, count, h = hash_words(offs, data)
        if not self.known:
            return np.zeros(len(count))
        return np.clip(self.bend(self.chance(ids, count), languages(h, count)), 0.0, 1.0)


def _adam(value: np.ndarray, grad: np.ndarray, state: dict, key: object, rate: float, step: int) -> None:
    m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
    m *= 0.9
    m += 0.1 * grad
    v *= 0.999
    v += 0.001 * grad * grad
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def train(rows: list[tuple[bytes, int, int]], seed: int = 5) -> Network:
    """rows: (bucket numbers as int32 bytes, language, label), in a fixed order."""
    net = Network(seed)
    labels = np.array([r[2] for r in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        net.known = False
        return net
    ids = [np.frombuffer(r[0], np.int32).reshape(-1, 3) for r in rows]
    language = np.array([r[1] for r in rows])
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    if labels[fit].min() == labels[fit].max():
        fit = order
    # Log odds of each bucket by presence in documents of either label.
    present = np.zeros((2, BUCKETS))
    for i in fit:
        present[int(labels[i]), np.unique(ids[i])] += 1
    n0, n1 = (labels[fit] == 0).sum(), (labels[fit] == 1).sum()
    odds = np.log((present[1] + 0.3) / (n1 + 0.6)) - np.log((present[0] + 0.3) / (n0 + 0.6))
    net.e[:, 0] = np.clip(np.where(present.sum(0) >= 2, odds, 0), -2, 4) / 4
    net.training, state, step = True, {}, 0
    weight = np.where(labels == 1, 0.5 * len(fit) / n1, 0.5 * len(fit) / n0).astype(np.float32)
    parts = max(1, len(fit) // 64)
    steps = max(EPOCHS * parts, STEPS)
    while step < steps:
        for batch in np.array_split(rng.permutation(fit), parts):
            step += 1
            x = np.concatenate([ids[i] for i in batch]) if len(batch) else np.zeros((0, 3), np.int32)
            count = np.array([len(ids[i]) for i in batch])
            top, where = net.pool(x, count)
            p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -30, 30)))
            g = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            rate = 0.01 * 0.05 ** (step / steps)
            d_top = g[:, None] * net.out[None, :]
            d_out = top.T @ g + 1e-4 * net.out
            bias = np.array([net.bias])
            _adam(bias, np.array([g.sum()]), state, "bias", rate, step)
            net.bias = bias[0]
            touched, d_e = [], []
            for c, k in enumerate(WIDTHS):
                cols = slice(c * FILTERS, (c + 1) * FILTERS)
                doc, filt = np.nonzero(where[:, cols] >= 0)
                at, d = where[:, cols][doc, filt], d_top[:, cols][doc, filt]
                d_w = np.zeros_like(net.w[c])
                for j in range(k):
                    vec = net.e[x[at + j]].sum(1)
                    np.add.at(d_w[j].T, filt, d[:, None] * vec)
                    touched.append(x[at + j].ravel())
                    d_e.append(np.repeat(d[:, None] * net.w[c][j].T[filt], 3, axis=0))
                d_b = np.bincount(filt, weights=d, minlength=FILTERS).astype(np.float32)
                _adam(net.w[c], d_w, state, ("w", c), rate, step)
                _adam(net.b[c], d_b, state, ("b", c), rate, step)
            _adam(net.out, d_out, state, "out", rate, step)
            if touched and sum(map(len, touched)):
                which, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(which), DIM), np.float32)
                np.add.at(grad, inverse, np.concatenate(d_e))
                net.e[which] -= 0.3 * rate * grad / (np.sqrt((grad**2).mean(1, keepdims=True)) + 1e-6)
    net.training = False
    calibrate(net, [ids[i] for i in (held if len(held) else fit)], language[held if len(held) else fit], labels[held if len(held) else fit])
    return net


def calibrate(net: Network, ids: list[np.ndarray], language: np.ndarray, labels: np.ndarray) -> None:
    """Each language's threshold: the middle of the best F1's range, drawn to all languages' one where rows are few."""
    p = np.concatenate([net.chance(np.concatenate(ids[i : i + 64]), np.array([len(x) for x in ids[i : i + 64]])) for i in range(0, len(ids), 64)])

    def best(p: np.ndarray, y: np.ndarray) -> float | None:
        if not len(y) or y.min() == y.max():
            return None
        grid = np.linspace(0.02, 0.98, 97)
        f1 = [2 * (y[p >= t].sum()) / max(1, (p >= t).sum() + y.sum()) for t in grid]
        return float(np.mean(grid[np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)]))

    common = best(p, labels) or 0.5
    for k in range(len(LANGUAGES)):
        of = language == k
        own = best(p[of], labels[of])
        n = labels[of].sum()
        net.thresholds[k] = np.clip(common if own is None else (own * n + common * 10) / (n + 10), 0.02, 0.98)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS, seed: int = 5) -> DataFrame:
    """doc_id, text and label of the documents that the network is trained on: none held out, equal rows once."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")).where(~held_out(F.col("_id")))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 20)) < int(train_rows / n * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # train_rows ids on average
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "text")).withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    rows = rows.where(F.col("_n") <= LONG)
    found, n_words = rows.groupBy("_id", "_h").agg(F.first("_n").alias("_n")).agg(F.count(F.lit(1)), F.sum("_n")).first()
    share = min(1.0, train_rows / max(1, found), train_words / max(1, n_words or 0))
    if found > n or share < 1:  # an id has several texts, or they are long: draw among them too
        rows = rows.where(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < int(share * (1 << 20)))
    once = rows.groupBy("_id", "_h").agg(F.first("text").alias("text"), F.first("_toxic").alias("_toxic"))
    return once.select(F.col("_id").cast("long").alias("doc_id"), "text", F.col("_toxic").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5, train_words: int = TRAIN_WORDS) -> Network:
    """A network from the labelled documents that are not held out."""
    rows = training_rows(docs, labels, train_rows, train_words, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offs, data in chunks(batch.column(1)):
                ids, count, h = hash_words(offs, data)
                parts = [x.tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(parts, pa.binary()), pa.array(languages(h, count).astype(np.int32)), batch.column(2).slice(lo, hi - lo)], names=["id", "ids", "language", "label"])

    encoded = rows.mapInArrow(run, "id long, ids binary, language int, label int")
    got = sorted(encoded.collect(), key=lambda r: (r[0], bytes(r[1])))
    return train([(bytes(r[1]), r[2], int(r[3] > 0)) for r in got], seed)


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs with a column of scores of all their whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{column}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo, hi, offs, data in chunks(batch.column(at), 1 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net.score(offs, data))], names=[*part.schema.names, column])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut."""
    name = fresh(docs, "toxicity")[0]
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net, name).where(F.col(name) < CUT).drop(name)
