"""Joins and selections: plain ones are Spark's own; these are the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def topk(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Ranges of keys that are one block when the next filled range is looked for.
BLOCK = 1024


def asof_forward(left: DataFrame, right: DataFrame, key: str, right_key: str, value: str, bucket: float) -> DataFrame:
    """left with the value at the smallest right key not under the left's; else that of the largest right key.

    Right keys are put in ranges of width bucket; a left row meets its own range and the next one that isn't empty,
    so rows are joined on equal ranges and not with all. The next filled range is found in the order of ranges, within blocks
    of BLOCK ranges and then from block to block.
    """
    cell = F.floor(F.col(right_key) / bucket)
    top = right.agg(F.max_by(F.struct(right_key, value), F.col(right_key)).alias("top"))
    held = right.select(cell.alias("cell"), F.col(right_key).alias("_k"), F.col(value).alias("_v"))
    rows = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("cell", F.floor(F.col(key) / bucket))
    own = rows.join(held, "cell", "left").groupBy("_row").agg(F.min(F.when(F.col("_k") >= F.col(key), F.struct("_k", "_v"))).alias("own"))
    asked = rows.where(F.col("cell").isNotNull()).select("cell", F.lit(None).cast(held.select(F.struct("_k", "_v").alias("low")).schema["low"].dataType).alias("low"))
    marks = held.select("cell", F.struct("_k", "_v").alias("low")).unionByName(asked).groupBy("cell").agg(F.min("low").alias("low"))
    marks = marks.withColumn("block", F.floor(F.col("cell") / BLOCK))
    after = Window.partitionBy("block").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    blocks = marks.groupBy("block").agg(F.min_by("low", F.when(F.col("low").isNotNull(), F.col("cell"))).alias("least"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # over one row for each block
    blocks = blocks.select("block", F.first("least", ignorenulls=True).over(later).alias("next"))
    above = marks.withColumn("near", F.first("low", ignorenulls=True).over(after)).join(blocks, "block").select("cell", F.coalesce("near", "next").alias("above"))
    out = rows.join(own, "_row", "left").join(above, "cell", "left").crossJoin(F.broadcast(top))
    pick = F.coalesce(F.col("own._v"), F.col("above._v"), F.col(f"top.{value}"))
    return out.select(*left.columns, pick.alias(value))


def largest_overlap(left: DataFrame, right: DataFrame, bucket: float) -> DataFrame:
    """Intervals (id, lo, hi): each left one with the right one of largest overlap, its share of the left, or nulls.

    Both sides are dealt into the buckets that they touch; pairs meet in the first bucket that they share.
    """
    def dealt(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{p}id"), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi")).withColumn("b", F.explode(F.sequence(F.floor(F.col(f"{p}lo") / bucket), F.floor(F.col(f"{p}hi") / bucket))))

    meet = dealt(left, "l").join(dealt(right, "r"), "b").where(F.col("b") == F.greatest(F.floor(F.col("llo") / bucket), F.floor(F.col("rlo") / bucket)))
    over = F.least("lhi", "rhi") - F.greatest("llo", "rlo")
    best = meet.withColumn("overlap", over).where("overlap > 0").groupBy("lid").agg(F.max(F.struct(F.col("overlap"), (-F.col("rid")).alias("neg"))).alias("m"))
    out = left.join(best, F.col("id") == F.col("lid"), "left")
    return out.select("id", (-F.col("m.neg")).alias("match_id"), F.try_divide(F.col("m.overlap"), F.col("hi") - F.col("lo")).alias("overlap_frac"))


def overlap_gate(matched: DataFrame, least: float, rows: int) -> DataFrame:
    """Matches with enough overlap; none at all if fewer than so many stay."""
    kept = matched.where(F.col("overlap_frac") >= least)
    return kept.crossJoin(kept.agg((F.count(F.lit(1)) >= rows).alias("_ok"))).where("_ok").drop("_ok")


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Metric by metric difference of two runs; moved if it is more than 1e-9 or one side is missing."""
    j = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    moved = F.coalesce(F.abs(F.col("after") - F.col("before")) > 1e-9, F.lit(True))
    return j.withColumn("delta", F.col("after") - F.col("before")).withColumn("moved", moved)


def nearest_of_two(x: Column, a: Column, b: Column, override: Column) -> Column:
    return F.when(override, "unit").when(F.abs(x - a) < F.abs(x - b), "first").otherwise("second")
