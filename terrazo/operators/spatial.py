"""Points and polygons without a geometry library: centroids, nearest neighbours, containment, grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazo.session import scratch_path

from .neighbours import nearest


def shoelace_centroid(rings: DataFrame) -> DataFrame:
    """rings: id, part, seq, x, y. Area-weighted centroid over parts; a degenerate polygon gives its vertices' mean."""
    w = Window.partitionBy("id", "part").orderBy("seq")
    first = Window.partitionBy("id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = rings.withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(first))).withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(first)))
    c = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    d = d.withColumn("c", c)
    part = d.groupBy("id", "part").agg(F.sum("c").alias("a2"), F.sum((F.col("x") + F.col("x2")) * F.col("c")).alias("sx"), F.sum((F.col("y") + F.col("y2")) * F.col("c")).alias("sy"), F.sum("x").alias("vx"), F.sum("y").alias("vy"), F.count(F.lit(1)).alias("nv"))
    s = part.groupBy("id").agg(F.sum(F.abs("a2") / 2).alias("area"), F.sum(F.signum("a2") * F.col("sx") / 6).alias("mx"), F.sum(F.signum("a2") * F.col("sy") / 6).alias("my"), (F.sum("vx") / F.sum("nv")).alias("vx"), (F.sum("vy") / F.sum("nv")).alias("vy"))
    ok = F.col("area") > 1e-12
    return s.select("id", "area", F.when(ok, F.col("mx") / F.nullif(F.col("area"), F.lit(0.0))).otherwise(F.col("vx")).alias("cx"), F.when(ok, F.col("my") / F.nullif(F.col("area"), F.lit(0.0))).otherwise(F.col("vy")).alias("cy"))


def knn(points: DataFrame, k: int, cell: float, same: str | None = None, carry: str | None = None) -> DataFrame:
    """points: id, x, y. src, dst, rank, d2 of the k nearest others, ties by id; exact. same: neighbours agree in this column.
    carry: a column of points that comes out too, with dst's value.

    cell is of no effect any more: blocks follow the points' density.
    """
    return nearest(points, points, k, [same] if same else [], others=True, carry=carry)


def point_in_polygon(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """points: id, x, y; edges: poly, x1, y1, x2, y2. id, poly of each point within, by crossings of a ray to the right.

    An edge is dealt to the rows of cells that it spans in y, so a point meets only edges at its height.
    """
    e = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    p = points.withColumn("band", F.floor(F.col("y") / cell))
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hits = p.join(e, "band").where(spans & (F.col("x") < at)).groupBy("id", "poly").agg(F.count(F.lit(1)).alias("c"))
    return hits.where("c % 2 = 1").select("id", "poly")


def grid_cell(size: float):
    return F.concat_ws("_", F.floor(F.col("x") / size), F.floor(F.col("y") / size))


#: A tile has so many cells on a side; a dense array stands for its cells where it has at most DENSE places for each.
TILE, DENSE = 4096, 64
#: Rows of a task, about.
TASK_ROWS = 300_000


def _means(rr: np.ndarray, cc: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], radius: int) -> list[np.ndarray]:
    """At distinct cells: each layer's mean over the square around. held: each layer's sums and counts."""
    r0, c0 = int(rr.min()), int(cc.min())
    h, w = int(rr.max()) - r0 + 1 + 2 * radius, int(cc.max()) - c0 + 1 + 2 * radius
    span = range(2 * radius + 1)
    y, x = rr - r0 + radius, cc - c0 + radius
    if h * w <= DENSE * len(rr) + 10_000:
        def around(v: np.ndarray) -> np.ndarray:
            g = np.zeros((h, w), v.dtype)
            g[y, x] = v
            rows = sum(g[k : h - 2 * radius + k] for k in span)
            return sum(rows[:, k : w - 2 * radius + k] for k in span)[y - radius, x - radius]
    else:
        key = y * w + x
        order = np.argsort(key)
        key_ = key[order]
        at = [np.searchsorted(key_, key + j * w + i) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]
        steps = [j * w + i for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]

        def around(v: np.ndarray) -> np.ndarray:
            v = np.append(v[order], v.dtype.type(0))
            keys = np.append(key_, -1)
            return sum(np.where(keys[a] == key + s, v[a], 0) for a, s in zip(at, steps, strict=True))

    return [around(s) / around(n) for s, n in held]


def smooth(cells: DataFrame, layers: list[str], radius: int) -> DataFrame:
    """cells: rr, cc, layers. Cells that have all layers, with each layer's mean over the square around; missing values are left out.

    Cells move once, to the tile that holds them, and those at a tile's border to its neighbours too; sums are taken there.
    """
    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("rr", "cc")}
    d = cells.select(F.col("rr").cast("long").alias("rr"), F.col("cc").cast("long").alias("cc"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).cast("double").alias(c) for c in layers])
    d = d.where(F.col("rr").isNotNull() & F.col("cc").isNotNull())
    for a, t in (("rr", "_ty"), ("cc", "_tx")):
        d = d.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - radius) / TILE), F.floor((F.col(a) + radius) / TILE))))
    n = cells.count()
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_ROWS)

    def tile(t: pa.Table) -> pa.Table:
        col = {c: t[c].to_numpy(zero_copy_only=False) for c in ("rr", "cc", "_ty", "_tx")}
        rr, cc = col["rr"], col["cc"]
        order = np.lexsort((cc, rr))
        rr, cc = rr[order], cc[order]
        new = np.append(True, (np.diff(rr) != 0) | (np.diff(cc) != 0))
        starts = np.flatnonzero(new)
        held = []
        for c in layers:
            v = t[c].combine_chunks().take(pa.array(order))
            held.append((np.add.reduceat(v.fill_null(0.0).to_numpy(), starts), np.add.reduceat(v.is_valid().to_numpy(zero_copy_only=False).astype(float), starts)))
        rr, cc = rr[starts], cc[starts]
        own = (rr // TILE == col["_ty"][0]) & (cc // TILE == col["_tx"][0])
        for _, k in held:
            own &= k > 0
        with np.errstate(invalid="ignore"):
            mean = _means(rr, cc, held, radius)
        return pa.table({"rr": rr[own], "cc": cc[own], **{c: m[own] for c, m in zip(layers, mean, strict=True)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            ty, tx = (t[c].to_numpy() for c in ("_ty", "_tx"))
            edge = np.append(np.flatnonzero((np.diff(ty) != 0) | (np.diff(tx) != 0)) + 1, len(t))
            if held and (held[0]["_ty"][0].as_py(), held[0]["_tx"][0].as_py()) != (ty[0], tx[0]):
                yield from tile(pa.concat_tables(held)).to_batches(max_chunksize=50_000)
                held = []
            held.append(t.slice(0, edge[0]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                yield from tile(pa.concat_tables(held)).to_batches(max_chunksize=50_000)
                held = [t.slice(lo, hi - lo)]
        if held:
            yield from tile(pa.concat_tables(held)).to_batches(max_chunksize=50_000)

    shape = "rr long, cc long, " + ", ".join(f"`{c}` double" for c in layers)
    out = d.repartition(tasks, "_ty", "_tx").sortWithinPartitions("_ty", "_tx").mapInArrow(run, shape)
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("rr", "cc")], *layers)


def percentiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """Exact percentiles, between two values in a line, without all values in one place: those near each are counted."""
    v = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    wide = 2e-4
    low = [F.percentile_approx("v", F.lit(max(0.0, p - wide)), 10_000) for p in at]
    high = [F.percentile_approx("v", F.lit(min(1.0, p + wide)), 10_000) for p in at]
    first = v.agg(F.count("v"), F.min("v"), F.max("v"), *low, *high).first()
    n, out = first[0], []
    if not n:
        return [None] * len(at)
    for i, p in enumerate(at):
        place = p * (n - 1)
        lo, hi = first[3 + i], first[3 + len(at) + i]
        below = v.where(F.col("v") < lo).count()
        near = sorted(map(tuple, v.where(F.col("v").between(lo, hi)).groupBy("v").count().collect()))
        if not below <= int(place) <= int(np.ceil(place)) < below + sum(c for _, c in near):  # the approximate ones missed
            out.append(v.agg(F.percentile("v", p)).first()[0])
            continue
        ends = below + np.cumsum([c for _, c in near])
        a, b = (near[int(np.searchsorted(ends, k, side="right"))][0] for k in (int(place), int(np.ceil(place))))
        out.append(float(a if a == b else (np.ceil(place) - place) * a + (place - int(place)) * b))
    return out


def _extremes(cells: DataFrame, layers: list[str], low: float, high: float) -> DataFrame:
    """cells with dark and bright: at or beyond the low and high percentile of every layer."""
    path = scratch_path(cells.sparkSession, "means")
    cells.write.parquet(path)
    cells = cells.sparkSession.read.schema(cells.schema).parquet(path)
    dark, bright = F.lit(True), F.lit(True)
    for c in layers:
        a, b = percentiles(cells, c, [low, high])
        dark, bright = dark & (F.col(c) <= F.lit(a).cast("double")), bright & (F.col(c) >= F.lit(b).cast("double"))
    return cells.withColumn("dark", dark).withColumn("bright", bright)


def blobs(cells: DataFrame) -> DataFrame:
    """cells: rr, cc, distinct. rr, cc, blob (its least cell), size of the blob of cells that touch by their sides.

    Labels fall to the least label around, at cells and at the cells that name labels, and are followed one step a round.
    """
    spark, path = cells.sparkSession, scratch_path(cells.sparkSession, "blobs")

    def cut(df: DataFrame, tag: str) -> DataFrame:
        df.write.parquet(f"{path}/{tag}")
        return spark.read.schema(df.schema).parquet(f"{path}/{tag}")

    lab = cut(cells.select(F.struct("rr", "cc").alias("a")).withColumn("l", F.col("a")), "0")
    sides = F.explode(F.array(*[F.struct((F.col("a.rr") + y).cast(cells.schema["rr"].dataType).alias("rr"), (F.col("a.cc") + x).cast(cells.schema["cc"].dataType).alias("cc")) for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    edges = cut(lab.select("a", sides.alias("b")).join(lab.select(F.col("a").alias("b")), "b"), "edges")
    for i in range(1, 200):
        e = edges.join(lab.withColumnRenamed("l", "la"), "a").join(lab.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b")
        told = e.select("a", "lb").unionByName(e.select(F.col("la").alias("a"), "lb")).groupBy("a").agg(F.min("lb").alias("m"))
        new = cut(lab.join(told, "a", "left").select("a", F.least("l", "m").alias("l"), F.col("l").alias("was")), f"{i}n")
        to = new.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = cut(new.join(to, "l").select("a", F.col("ll").alias("l"), "was"), str(i))
        lab = new.select("a", "l")
        if new.where("l <> was").isEmpty():
            break
    sizes = lab.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
    return lab.join(sizes, "l").select("a.rr", "a.cc", F.col("l").alias("blob"), "size")


def landcover_masks(cells: DataFrame, layers: list[str], least: int = 40) -> DataFrame:
    """cells: rr, cc, one layer for each date. rr, cc, dark, water, built, crop of the cells that have every date.

    Dark and built: 5 x 5 means at or beyond the 2nd and 99th percentile on every date; water: dark blobs of so many cells.
    Means are over the cells that are there (the reference counts missing ones as 0 and mirrors at the edges).
    """
    m = _extremes(smooth(cells, layers, 2), layers, 0.02, 0.99).select("rr", "cc", "dark", "bright")
    path = scratch_path(cells.sparkSession, "masks")
    m.write.parquet(path)
    m = cells.sparkSession.read.schema(m.schema).parquet(path)
    large = blobs(m.where("dark").select("rr", "cc")).where(F.col("size") >= least).select("rr", "cc", F.lit(True).alias("water"))
    out = m.join(large, ["rr", "cc"], "left").withColumn("water", F.coalesce("water", F.lit(False)))
    return out.select("rr", "cc", "dark", "water", F.col("bright").alias("built"), (~F.col("water") & ~F.col("bright")).alias("crop"))


def landcover_candidates(cells: DataFrame, layer: str) -> DataFrame:
    """rr, cc, mean, dark, bright of cells with data (not 0): 9 x 9 means over data, darkest 1 % and brightest 0.3 %."""
    m = smooth(cells.where(F.col(layer) != 0), [layer], 4)
    return _extremes(m, [layer], 0.01, 0.997).withColumnRenamed(layer, "mean")
