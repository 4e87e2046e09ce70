"""What the operators of this subpackage share: the shared folder, cut lineage, size checks."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazo.session import scratch_path, ship

#: Largest table, in rows of a few numbers each, that an operator sends to every executor.
BROADCAST_ROWS = 500_000


class Scratch:
    """Tables that one call writes to the shared folder. drop() removes those that nothing reads any more; the rest goes when the
    application ends, since results are read from them until then."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, scratch_path(spark, name)
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(root)
        files.deleteOnExit(root)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back: later stages restart from the files, not from df's lineage."""
        df.write.mode("overwrite").parquet(f"{self.root}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for tag in tags:
            p = path(f"{self.root}/{tag}")
            p.getFileSystem(conf).delete(p, True)
        # Shuffle files of plans that are gone go when the driver's garbage is collected.
        gc.collect()
        self.spark._jvm.System.gc()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows are within the limit; else Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= limit else df.hint("shuffle_hash" if rows < 20 * limit else "merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not, for helper columns: each name, with underscores put before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
