"""Rows whose doc_id is null or shared by other texts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from terrazo.llm import jaccard, sharding, substrings

from . import brute


def words(tag, n):
    return [f"{tag}{k}" for k in range(n)]


def test_substrings_of_shared_and_null_ids(spark):
    x, y, z = words("x", 20), words("y", 40), words("z", 31)
    rng = random.Random(4)
    for ids in ((None, None, None, 4), (7, 7, 7, 4), (1, 2, 3, 4), (None, 5, 5, 5)):
        texts = [" ".join(x + x), " ".join(y), " ".join(z[:25] + y[5:30] + ["q"]), " ".join(y[:22] + z)]
        rows = list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (ids[1], None), (ids[1], "")]
        rng.shuffle(rows)
        d = spark.createDataFrame(rows, "doc_id long, text string")
        order = {r[0]: r[1] for r in d.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
        want = brute.repeats_of_texts(rows, 20, order.get)
        got = substrings.dedup(d).collect()
        assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_nothing_that_repeats_nowhere_goes(spark):
    for i in (None, 7):
        d = spark.createDataFrame([(i, " ".join(words("x", 20) * 2)), (i, " ".join(words("y", 40)))], "doc_id long, text string")
        assert sorted(r["n_removed"] for r in substrings.dedup(d).collect()) == [0, 20]


def test_one_of_each_class_stays(spark):
    a, b, c = (words(t, 40) for t in "abc")
    near_a = [*a[:-1], "other"]
    texts = {"a": " ".join(a), "A": " ".join(a).upper(), "near a": " ".join(near_a), "b": " ".join(b), "c": " ".join(c), "": "", None: None}
    rows = [(7, "a", 1), (7, "b", 2), (None, "a", 3), (None, "c", 4), (None, "c", 5), (None, "b", 6), (9, "near a", 7), (7, "b", 8), (3, "A", 9), (4, "", 10), (4, None, 11), (None, "", 12), (5, "c", 13), (5, "c", 13)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame([(i, texts[t], k, "x", "y") for i, t, k in order], "doc_id long, text string, row_key int, rows string, class string")
        out = jaccard.stage(spark, d, "")
        assert out.columns == d.columns
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        want = Counter([(3, texts["A"]), (7, texts["b"]), (5, texts["c"]), (4, ""), (4, None), (None, "")])
        assert got == want
    assert jaccard.stage(spark, d.limit(0), "").collect() == []


def test_shards_keep_columns_and_scatter_equal_rows(spark):
    rows = [(None, None, "keep me", 5, "h")] * 300 + [(1, "same " * 40, "s", 6, "h")] * 500 + [(i, "t" * (i % 50), "keep", i, "h") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, hash string")
    out = sharding.stage(spark, d.repartition(3), "", bucket_bytes=8000)
    assert out.columns == [*d.columns, "_shard", "_slot"]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    counts = Counter(r["_shard"] for r in got)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    of = brute.groups((r["_shard"], r["_slot"]) for r in got)
    assert all(sorted(v) == list(range(counts[s])) for s, v in of.items())
    # The copies stand all over the order.
    places = sorted(r["_slot"] * 40 + r["_shard"] for r in got if r["doc_id"] == 1)
    assert places[0] < 150 and places[-1] > 1350 and max(b - a for a, b in zip(places, places[1:])) < 150
    again = sharding.stage(spark, d.repartition(5), "", bucket_bytes=8000)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
