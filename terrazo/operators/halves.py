"""Random halves of groups: each group moves once, and all its splits are made where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazo.functions import digests

#: Rows of a task, about; a kernel takes whole groups of so many rows together.
TASK_ROWS, AT_ONCE = 300_000, 50_000
#: Groups are counted by hash in so many parts; those of a part with more rows than this are split by windows, which spill.
PARTS, HEAVY = 1 << 16, 2_000_000


def _split(t: pa.Table, reps: int) -> pa.RecordBatch:
    """t: g, a, b (whole numbers), v, in order of g. g and sd of its groups."""
    t = t.combine_chunks()
    n, (g, a, b, v) = len(t), (t[c].combine_chunks() for c in "gabv")
    no_g, no_a, no_b, no_v = (c.is_null().to_numpy(zero_copy_only=False) for c in (g, a, b, v))
    gs, as_, bs = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (g, a, b))
    vs = v.fill_null(0.0).to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (gs[1:] != gs[:-1]) | (no_g[1:] != no_g[:-1])
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    second = (np.arange(n) - starts[of]) % 2 == 1  # an even number in the group's order, which begins with 1
    hashless = no_a | no_b
    tails, long = digests.suffixes(pc.binary_join_element_wise(pc.cast(a, pa.string()), pc.cast(b, pa.string()), "|"))
    ties = (vs, no_v, bs, no_b, as_, no_a)
    bits = np.uint64(max(1, int(len(starts)).bit_length()))
    high = of.astype(np.uint64) << (np.uint64(64) - bits)
    blocks: dict[int, np.ndarray] = {}
    d, known = np.empty((reps, len(starts))), np.empty((reps, len(starts)), bool)
    for rep in range(reps):
        head = f"{rep}|".encode()
        if len(head) not in blocks:
            blocks = {len(head): digests.blocks(tails, long, len(head))}
        top, low = digests.md5(blocks[len(head)], head)
        if hashless.any():
            top[hashless], low[hashless] = 0, 0
            order = np.lexsort((*ties, low, top, hashless, of))
        else:
            key = high | top >> bits
            order = np.argsort(key)
            sorted_ = key[order]
            same = np.zeros(n, bool)
            same[1:] = sorted_[1:] == sorted_[:-1]
            same[:-1] |= same[1:]
            if same.any():
                few = order[same]
                order[same] = few[np.lexsort((*(x[few] for x in ties), low[few], top[few], of[few]))]
        w, there = vs[order], ~no_v[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            many = [np.add.reduceat(half & there, starts, dtype=np.int64) for half in (second, ~second)]
            mean = [np.add.reduceat(np.where(half & there, w, 0.0), starts) / c for half, c in zip((second, ~second), many, strict=True)]
        d[rep], known[rep] = mean[0] - mean[1], (many[0] > 0) & (many[1] > 0)
    k = known.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mid = np.where(known, d, 0.0).sum(0) / k
        sd = np.sqrt((np.where(known, d - mid, 0.0) ** 2).sum(0) / k)
    return pa.RecordBatch.from_arrays([g.take(pa.array(starts)), pa.array(sd, pa.float64(), mask=k == 0)], ["g", "sd"])


def half_sd(rows: DataFrame, reps: int) -> DataFrame:
    """rows: g, a, b (whole numbers), v. g and sd: the deviation, over so many splits of a group's rows into halves, of the halves' means' difference.

    Split rep deals the rows in turn, in the order of md5(rep|a|b), then a, b and v, missing ones last. The groups are dealt
    to tasks once, for all splits.
    """
    kind = rows.schema["g"].dataType
    rows = rows.select("g", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("v").cast("double").alias("v"))
    part = F.pmod(F.xxhash64("g"), F.lit(PARTS))
    counts = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).select("n", F.when(F.col("n") > HEAVY, F.col("p")).alias("p"))
    total, heavy = counts.agg(F.sum("n"), F.collect_list("p")).first()  # at most total / HEAVY of them
    light = rows.where(~part.isin(heavy)) if heavy else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, AT_ONCE
        for b in batches:
            if not len(b):
                continue
            held.append(pa.Table.from_batches([b]))
            n += len(b)
            if n >= most:
                t = pa.concat_tables(held)
                end = t["g"][n - 1]
                whole = n - (pc.sum(pc.equal(t["g"], end) if end.is_valid else t["g"].is_null()).as_py() or 0)
                if whole:
                    yield _split(t.slice(0, whole), reps)
                held, n = [t.slice(whole)], n - whole
                most = max(AT_ONCE, 2 * n)  # the last group may go on in the next batch
        if n:
            yield _split(pa.concat_tables(held), reps)

    tasks = max(1, -(-(total or 0) // TASK_ROWS))
    out = light.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(run, f"g {kind.simpleString()}, sd double")
    if not heavy:
        return out
    each = rows.where(part.isin(heavy)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    hash_ = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.md5(F.concat_ws("|", "rep", "a", "b")))
    w = Window.partitionBy("g", "rep").orderBy(*[c.asc_nulls_last() for c in (hash_, F.col("a"), F.col("b"), F.col("v"))])
    mean = [F.avg(F.when(F.col("half") == i, F.col("v"))) for i in (0, 1)]
    m = each.withColumn("half", F.row_number().over(w) % 2).groupBy("g", "rep").agg((mean[0] - mean[1]).alias("d"))
    return out.unionByName(m.groupBy("g").agg(F.stddev_pop("d").alias("sd")))
