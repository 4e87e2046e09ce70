"""Mixing sources to target weights, by pivotal dependent rounding, with DataFrame and SQL functions only.

A source's target is its share of all words by weight, or three times what it has if that is less;
what it can't use goes to the others by weight. A document of source s is to be taken target/size
times, a number whose whole part is sure and whose fraction p is rounded: two units, each with a
fraction and a weight in words, hand mass from one to the other (so that the sum of weight times
fraction stays) until one of them is 0 or 1; which way is drawn so that each fraction's expectation
stays. Units of a source are dealt into buckets of FAN on average by a hash; within a bucket they
meet one after the other, the heaviest first, and at most one is left with a fraction. Those meet FAN
buckets at a time on the next level, and so on up to one for each source, which goes to its nearer
whole number. So no task holds more than some hundreds of units, however large a source is.

Defined cases: a null text has no words and is taken 0 words; a null source is a source, the last;
rows that agree in doc_id, source and text are one unit, taken alike; a source without words has
target 0 and its documents are taken once or not at all by the first rule (0 copies); an empty table
gives an empty one. Draws are hashes of the seed and the units, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh

#: Units that meet in one bucket, on average.
FAN = 64
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row for each source: source, source_size, n_units, target. The windows run over sources only."""
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("_ratio"), F.col("_rn"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_rn", F.row_number().over(by_name))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(MOST_COPIES) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    # In order of cap over weight: the level at which the rest of the mass, shared by weight, overfills no source from here on.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_rn"), F.col("_level")))).over(everything)
    s = s.withColumn("_water", first["_level"])
    target = F.when(F.col("_water").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("_w")))
    return s.select("source", "source_size", "n_units", target.alias("target"))


def _step(seed: int) -> str:
    """SQL of one meeting: a is what the bucket holds so far (res: the unit with a fraction), x the next unit."""
    unit = "named_struct('h', {0}.h, 'id', {0}.id, 'k', {0}.k, 's', {0}.s, 'w', {0}.w, 'p', {1})"
    done = "named_struct('id', {0}.id, 'k', {0}.k, 's', {0}.s, 'up', {1} = 1D)"
    meet = (
        "named_struct('give', least(1D - a.res.p, x.p * x.w / a.res.w), 'take', least(a.res.p, (1D - x.p) * x.w / a.res.w),"
        f" 'u', (xxhash64({seed}, a.res.h, x.h) & 4503599627370495L) / 4503599627370496D)"
    )
    moved = (
        "CASE WHEN m.u * (m.give + m.take) < m.take THEN"
        " CASE WHEN 1D - a.res.p <= x.p * x.w / a.res.w THEN named_struct('q', 1D, 'r', greatest(0D, x.p - m.give * a.res.w / x.w)) ELSE named_struct('q', a.res.p + m.give, 'r', 0D) END"
        " ELSE CASE WHEN a.res.p <= (1D - x.p) * x.w / a.res.w THEN named_struct('q', 0D, 'r', least(1D, x.p + m.take * a.res.w / x.w)) ELSE named_struct('q', a.res.p - m.take, 'r', 1D) END END"
    )
    snap = "CASE WHEN {0} < 1e-9D THEN 0D WHEN {0} > 1D - 1e-9D THEN 1D ELSE {0} END"
    snapped = f"named_struct('q', {snap.format('v.q')}, 'r', {snap.format('v.r')})"
    none = "CAST(NULL AS struct<h:bigint,id:bigint,k:bigint,s:bigint,w:double,p:double>)"
    settle = (
        "CASE WHEN z.q IN (0D, 1D) AND z.r IN (0D, 1D) THEN"
        f" named_struct('res', {none}, 'done', a.done || array({done.format('a.res', 'z.q')}, {done.format('x', 'z.r')}))"
        f" WHEN z.q IN (0D, 1D) THEN named_struct('res', {unit.format('x', 'z.r')}, 'done', a.done || array({done.format('a.res', 'z.q')}))"
        f" ELSE named_struct('res', {unit.format('a.res', 'z.q')}, 'done', a.done || array({done.format('x', 'z.r')})) END"
    )
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return f"CASE WHEN a.res IS NULL THEN named_struct('res', {unit.format('x', 'x.p')}, 'done', a.done) ELSE {let('m', meet, let('v', moved, let('z', snapped, settle)))} END"


def _round_buckets(level: DataFrame, seed: int) -> DataFrame:
    """level: source, bucket, unit. Gives source, bucket, done (array), res (the unit left or null)."""
    none = "CAST(NULL AS struct<h:bigint,id:bigint,k:bigint,s:bigint,w:double,p:double>)"
    zero = f"named_struct('res', {none}, 'done', CAST(array() AS array<struct<id:bigint,k:bigint,s:bigint,up:boolean>>))"
    ordered = "array_sort(units, (l, r) -> CASE WHEN l.w > r.w THEN -1 WHEN l.w < r.w THEN 1 WHEN l.h < r.h THEN -1 WHEN l.h > r.h THEN 1 ELSE 0 END)"
    rounded = level.groupBy("source", "bucket").agg(F.collect_list("unit").alias("units")).select("source", "bucket", F.expr(f"aggregate({ordered}, {zero}, (a, x) -> {_step(seed)})").alias("o"))
    return rounded.select("source", "bucket", "o.done", "o.res")


def plan(units: DataFrame, seed: int = 11, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """units: id, source, k, size, n (equal rows). Gives id, source, k, size, n, source_size, target, copies."""
    spark = units.sparkSession
    scratch = Scratch(spark, "mix")
    units = scratch.cut(units, "units")
    goal = scratch.cut(targets(units, weights), "targets")
    most = goal.agg(F.max("n_units")).first()[0] or 0
    # One row for each source: broadcast only if it is counted and small.
    n_sources = goal.count()
    goal = goal.withColumnRenamed("source", "_name")
    goal_side = F.broadcast(goal) if n_sources <= 10_000 else goal
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = units.join(goal_side, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    whole = F.least(F.floor(rate + 1e-12), F.lit(MOST_COPIES)).cast("long")
    part = F.greatest(F.lit(0.0), rate - whole)
    rated = rated.withColumn("whole", whole).withColumn("part", F.when(part < 1e-9, 0.0).otherwise(part))
    h = F.xxhash64(F.lit(seed), F.col("id"), F.col("k"), F.col("source"))
    buckets = F.ceil(F.col("n_units") / F.lit(FAN))
    to_round = rated.where("part > 0 and size > 0").select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed + 1), h), buckets).cast("long").alias("bucket"),
        F.struct(h.alias("h"), "id", "k", F.col("size").alias("s"), (F.col("size") * F.col("n")).cast("double").alias("w"), F.col("part").alias("p")).alias("unit"),
    )
    ups, level, n = [], to_round, most
    for depth in range(64):
        done = scratch.cut(_round_buckets(level, seed + 2 + depth), f"level{depth}")
        ups.append(done.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.k", "d.s", F.col("d.up").cast("int").alias("up")))
        n = -(-n // FAN)
        if n <= 1:
            ups.append(done.where("res is not null").select("source", "res.id", "res.k", "res.s", (F.col("res.p") >= 0.5).cast("int").alias("up")))
            break
        level = done.where("res is not null").select("source", F.floor(F.col("bucket") / F.lit(FAN)).cast("long").alias("bucket"), F.col("res").alias("unit"))
    taken = ups[0]
    for more in ups[1:]:
        taken = taken.unionByName(more)
    taken = taken.select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("k").alias("_k"), "up")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_source"))
    out = rated.join(taken, same, "left")
    return out.select("id", "source", "k", "size", "n", "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def units_of(docs: DataFrame) -> DataFrame:
    """The distinct (doc_id, source, text) of docs with their number of words and of rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "source", F.xxhash64("text").alias("k"), word_count(F.col("text")).alias("size"))
    return rows.groupBy("id", "source", "k", "size").agg(F.count(F.lit(1)).alias("n"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: docs' rows, each as many times as it is taken (0 to 3), in docs' columns."""
    h, key, n, i, s, c = fresh(docs, "h", "id", "copies", "copy", "src", "k")
    p = plan(units_of(docs), seed).where("copies > 0").select(F.col("id").alias(key), F.col("source").alias(s), F.col("k").alias(c), F.col("copies").alias(n))
    rows = docs.withColumn(h, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(h) == F.col(c)) & F.col("source").eqNullSafe(F.col(s))
    joined = rows.join(p, same)
    return joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(units_of(documents(spark, sf_dir)))
    rows = p.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)
