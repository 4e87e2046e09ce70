"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by a seeded hash of their content.
Pass two shuffles each bucket by Fisher-Yates, with a generator seeded by the bucket. A record's
rank in the whole order is its bucket's offset plus its place in the bucket; rank r goes to shard
r mod n, slot r div n. So counts of shards differ by one at most, and slots have no gaps. Buckets' offsets are
known before they are filled, from the counts of hashes. Both passes move the whole records; each task of pass two
shuffles its buckets and writes their records to the shards' folders, in order of slots (a later bucket's slots
are above an earlier one's). So the disk holds the records twice at most: as scattered, and in their shards.

Rows that agree in all keys have one hash. Where they weigh more than a part of a bucket they are counted, and each of
the copies gets a hash of its own from its number, so that they scatter as other rows do.

Defined cases: a null text has the size of a row without text and the crc of an empty one; rows that are equal in all
columns stay apart and get slots of their own; an empty table gives an empty one; columns of the caller are kept,
whatever their names: where he has shard or slot, the new ones are _shard or _slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, fresh

SHARDS = 40
SEED = 7
BUCKET_BYTES = 64 << 20
#: Rows weigh so many bytes besides their text.
ROW_BYTES = 16
#: Rows of one hash that weigh more than this share (one in so many) of a bucket are scattered one by one.
HEAVY = 4
#: Copies that one task numbers.
COPIES = 1024


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform order of 0..n-1 by swaps of each place, from the last on, with one not after it."""
    order = np.arange(n)
    picks = np.floor(rng.random(n) * np.arange(n, 0, -1)).astype(np.int64)[: max(0, n - 1)]
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def _scattered(keyed: DataFrame, hash_: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed whose hash isn't in heavy; the others, with a hash for each copy. Equal rows are counted and come out as many times again.

    heavy has a row for each part of a bucket at most, so it is sent to every executor.
    """
    part, copy, n = fresh(keyed, "part", "copy", "n")
    heavy = F.broadcast(heavy)
    cols = [F.col(f"`{c}`") for c in keyed.columns]
    counted = keyed.join(heavy, hash_, "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    parts = counted.withColumn(part, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / COPIES)))).repartition(F.col(f"`{hash_}`"), F.col(part))
    first = F.col(part) * COPIES
    each = parts.withColumn(copy, F.explode(F.sequence(first, F.least(F.col(n), first + COPIES) - 1)))
    own = F.xxhash64(*cols, F.col(copy))
    return keyed.join(heavy, hash_, "left_anti").select(*cols), each.withColumn(hash_, own).select(*cols)


def _ordered(df: DataFrame, size: str, keys: list[str], shards: int, seed: int, bucket_bytes: int, scratch: Scratch) -> DataFrame:
    """shuffle()'s rows, worked out as they are read: to be written once. They are read from df and from scratch's table weights."""
    hash_, bucket, place, offset, bytes_, rows_ = fresh(df, "hash", "bucket", "place", "offset", "bytes", "rows")
    shard, slot = fresh(df, "shard", "slot")
    keyed = df.withColumn(hash_, F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys]))
    weights = scratch.cut(keyed.groupBy(hash_).agg(F.sum(F.col(f"`{size}`").cast("double")).alias(bytes_), F.count(F.lit(1)).alias(rows_)), "weights")
    heavy = F.coalesce(F.col(bytes_) > bucket_bytes / HEAVY, F.lit(False))
    total, n_heavy = weights.agg(F.sum(bytes_), F.count(F.when(heavy, 1))).first()
    n = max(1, int(-(-(total or 0.0) // bucket_bytes)))
    of = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(hash_)), F.lit(n)).cast("int").alias(bucket)
    counts = weights.select(of, rows_)
    if n_heavy and n > 1:
        light, each = _scattered(keyed, hash_, weights.where(heavy).select(hash_))
        keyed = light.unionByName(each)
        counts = weights.where(~heavy).select(of, rows_).unionByName(each.groupBy(of).agg(F.count(F.lit(1)).alias(rows_)))
    keyed = keyed.select("*", of)
    out_type = T.StructType([*keyed.schema.fields, T.StructField(place, T.LongType(), False)])
    order = [hash_, *keys]

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        rng = np.random.Generator(np.random.PCG64([seed, key[0].as_py()]))
        rows = rows.take(pa.array(fisher_yates(len(rows), rng)))
        return rows.append_column(place, pa.array(np.arange(len(rows), dtype=np.int64)))

    shuffled = keyed.groupBy(bucket).applyInArrow(one, out_type)
    # One row for each bucket: the offsets are running sums over as many rows as there are memory-sized buckets.
    sizes = counts.groupBy(bucket).agg(F.sum(rows_).alias(rows_))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(bucket, F.coalesce(F.sum(rows_).over(w), F.lit(0)).alias(offset))
    rank = F.col(offset) + F.col(place)
    return (
        shuffled.join(F.broadcast(offsets) if n <= 100_000 else offsets, bucket)
        .withColumn(shard, F.pmod(rank, F.lit(shards)).cast("int"))
        .withColumn(slot, F.floor(rank / F.lit(shards)).cast("long"))
        .drop(hash_, bucket, place, offset)
    )


def shuffle(df: DataFrame, size: str, keys: list[str], shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with columns shard and slot, in a uniform random order that depends on the rows' keys and the seed alone.

    size: the column with a row's bytes, from which the number of buckets follows. keys: the columns
    that tell rows apart; rows that agree in all of them are in any order. df is read twice and must be
    the same each time. The result is read from a table in the shared folder.
    """
    scratch = Scratch(df.sparkSession, "shuffle")
    out = scratch.cut(_ordered(df, size, keys, shards, seed, bucket_bytes, scratch), "shuffled")
    scratch.drop("weights")
    return out


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", files: int = 1) -> None:
    """Write each shard to a folder of its own, in slot order, as about so many files each; a task writes one file's range of slots.

    files 0: rows stay in their tasks, and each task writes a file of its slots to each shard.
    """
    dealt = df.repartitionByRange(SHARDS * files, shard, slot) if files > 1 else df.repartition(shard) if files else df
    dealt.sortWithinPartitions(shard, slot).write.partitionBy(shard).mode("overwrite").parquet(path)


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        "doc_id",
        *more,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
    )


def sharded(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with shard and slot (_shard and _slot where documents have such columns), read back from the shards' files."""
    scratch = Scratch(docs.sparkSession, "shards")
    crc, size, shard, slot = fresh(docs, "text_crc32", "size", "shard", "slot")
    rows = docs.withColumn(crc, F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    out = _ordered(rows, size, ["doc_id", crc], SHARDS, SEED, bucket_bytes, scratch).drop(crc, size)
    write_shards(out, f"{scratch.root}/shards", shard, slot, 0)
    scratch.drop("weights")
    return docs.sparkSession.read.schema(out.schema).parquet(f"{scratch.root}/shards")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole documents in their shards: size and text_crc32 are of the texts as stored there."""
    out = sharded(documents(spark, sf_dir))
    return sized(out, "shard", "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, bucket_bytes: int = 16 << 20) -> DataFrame:
    """The documents with shard and slot (_shard and _slot where documents have such columns), the last stage of the pipeline."""
    crc, size = fresh(docs, "text_crc32", "size")
    rows = docs.withColumn(crc, F.xxhash64("text")).withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    return shuffle(rows, size, ["doc_id", crc], bucket_bytes=bucket_bytes).drop(crc, size)
