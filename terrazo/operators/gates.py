"""Data-quality gates: each gives one row (gate, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([("columns", df.columns == names, ",".join(df.columns))], "gate string, ok boolean, detail string")


def rows_ids(df: DataFrame, key: str, host: DataFrame) -> DataFrame:
    """Keys are unique and exactly the host's."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"))
    ids, ref = df.select(F.col(key).alias("k")), host.select(F.col(key).alias("k"))
    off = ids.exceptAll(ref).unionByName(ref.exceptAll(ids)).agg(F.count(F.lit(1)).alias("off"))
    return a.crossJoin(off).select(F.lit("rows_ids").alias("gate"), ((F.col("n") == F.col("d")) & (F.col("off") == 0)).alias("ok"), F.concat_ws("/", "n", "d", "off").alias("detail"))


def check(df: DataFrame, gate: str, ok: Column, detail: Column) -> DataFrame:
    return df.agg(ok.alias("ok"), detail.cast("string").alias("detail")).select(F.lit(gate).alias("gate"), F.coalesce("ok", F.lit(True)).alias("ok"), "detail")


def vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    bad = F.count_if(F.col(column).isNull() | ~F.col(column).isin(allowed))
    return check(df, "vocab", bad == 0, bad)


def in_range(df: DataFrame, gate: str, column: str, low: float, high: float, right_open: bool = False) -> DataFrame:
    c = F.col(column)
    good = (c >= low) & ((c < high) if right_open else (c <= high))
    bad = F.count_if(~F.coalesce(good, F.lit(False)))
    return check(df, gate, bad == 0, bad)


def golden(a: DataFrame, b: DataFrame) -> DataFrame:
    off = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("off"))
    return off.select(F.lit("golden").alias("gate"), (F.col("off") == 0).alias("ok"), F.col("off").cast("string").alias("detail"))
