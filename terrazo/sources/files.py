"""Sources and sinks: typed CSV, JSON lines, a run ledger, tiles, file resolution, schema probing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a stated schema; blank and NaN numbers are null."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    return df.select(*[F.nullif(c, F.lit(float("nan"))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_ledger(spark: SparkSession, path: str, stage: str, fields: dict[str, str]) -> None:
    row = spark.createDataFrame([(stage, fields)], "stage string, fields map<string,string>").withColumn("t", F.current_timestamp())
    row.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t timestamp, stage string, fields map<string,string>").json(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """Raster tiles (grid, date, tile, row, col, value) as Parquet, one folder for each grid and date."""
    df.repartition("grid", "date").sortWithinPartitions("tile", "row", "col").write.partitionBy("grid", "date").mode("overwrite").parquet(path)


def read_window(spark: SparkSession, path: str, grid: str, date: str, rows: tuple[int, int], cols: tuple[int, int], step: int = 1) -> DataFrame:
    """A decimated window of the tiles; partitions are pruned, row and column bounds reach the scan."""
    d = spark.read.parquet(path).where((F.col("grid") == grid) & (F.col("date") == date))
    return d.where(F.col("row").between(*rows) & F.col("col").between(*cols) & (F.col("row") % step == 0) & (F.col("col") % step == 0))


def resolve(files: DataFrame, date: str) -> DataFrame:
    """Paths whose folder and file name both hold the date; the caller needs exactly one."""
    base, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.where(F.contains(base, F.lit(date)) & F.contains(folder, F.lit(date)))


def pick_schema(spark: SparkSession, paths: list[str], columns: set[str], rows: int | None = None) -> str | None:
    """The first Parquet path that can be read and has the columns (and so many rows)."""
    from pyspark.errors import AnalysisException

    for p in paths:
        try:
            df = spark.read.parquet(p)
        except AnalysisException:
            continue
        if columns <= set(df.columns) and (rows is None or df.count() == rows):
            return p
    return None


def paged(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Landed pages up to the first that brings no new id, each id once (from its earliest page)."""
    from pyspark.sql import Window

    first = pages.withColumn("_first", F.min(page).over(Window.partitionBy(key)))
    fresh = first.groupBy(page).agg(F.count_if(F.col("_first") == F.col(page)).alias("new"))
    stop = fresh.where("new = 0").agg(F.min(page).alias("stop"))
    kept = first.where(F.col("_first") == F.col(page)).crossJoin(F.broadcast(stop))
    return kept.where(F.col("stop").isNull() | (F.col(page) < F.col("stop"))).drop("_first", "stop").dropDuplicates([key])
