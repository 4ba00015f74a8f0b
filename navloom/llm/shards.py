"""Sharding by a two-pass external shuffle.

Pass one scatters records over buckets that fit into a task's memory, by a seeded hash. Pass two brings every bucket into a
stable order, permutes it by Fisher-Yates with a generator seeded by the bucket, and deals the permuted records out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest bucket on average; up to MOST_SMALL buckets they are smaller, so that all tasks have some.
BUCKET_BYTES, SMALL_BYTES, MOST_SMALL = 16 << 20, 256 << 10, 4096
#: Equal rows over this part of a bucket are scattered one by one; bytes that a row takes besides its text; copies made at a time.
PARTS, ROW_BYTES, COPIES = 16, 64, 10_000


def record_bytes(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): from the end, each place swaps with one drawn from those up to it."""
    order = np.arange(n)
    if n > 1:
        draws = rng.integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def shuffle_shards(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs in a uniformly random order, dealt into n_shards: (id, text, bucket int, position long, shard int, slot long).

    position is the place in the whole order, from 0; shard = position mod n_shards and slot = position div n_shards, so shards
    differ by one row at most and slots are gapless in each. The same rows and seed give the same result, whatever the
    partitioning. Null texts count one byte. Rows are scattered by id and text, so rows that share only an id, or have none, don't
    meet in one bucket. Repeated rows each keep a place of their own (equal rows are interchangeable); where those of one id and
    text would fill a good part of a bucket, they are counted and made again as numbered copies that are scattered one by one. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    size = rows.agg(F.sum(record_bytes("_text"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes), min(MOST_SMALL, -(-size // SMALL_BYTES)))
    key = [F.lit(seed), F.col("_id").cast("string"), F.col("_text")]
    rows = rows.withColumn("_hash", F.xxhash64(*key))
    held = rows.select("_hash", (record_bytes("_text") + ROW_BYTES).alias("_b")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_b"))
    large = held.where((F.col("_n") > 1) & (F.col("_b") > bucket_bytes // PARTS)).select("_hash").collect()  # bytes / bucket_bytes * PARTS rows at most
    if large:
        large = F.broadcast(docs.sparkSession.createDataFrame([(r["_hash"],) for r in large], "_hash long"))
        counted = rows.join(large, "_hash", "left_semi").groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n"))
        runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES)))).repartition(F.xxhash64(*key, "_run"))
        first = F.col("_run") * COPIES
        copies = runs.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)))
        rows = rows.join(large, "_hash", "left_anti").select("_id", "_text", "_hash").unionByName(copies.select("_id", "_text", F.xxhash64(*key, "_copy").alias("_hash")))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row for each bucket: bytes / bucket_bytes rows
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_offset"))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("_id", id_type), T.StructField("_text", docs.schema[text_col].dataType), T.StructField("_bucket", T.IntegerType()), T.StructField("_position", T.LongType())]
    )

    def permute(bucket: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        if not len(bucket):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        bucket = bucket.sort_values(["_hash", "_id", "_text"], kind="stable", ignore_index=True)
        key = int(bucket["_bucket"].iloc[0])
        order = fisher_yates(len(bucket), np.random.default_rng([seed, key]))
        out = bucket.take(order).reset_index(drop=True)
        out["_position"] = np.arange(len(out), dtype=np.int64) + int(offset["_offset"].iloc[0])
        return out[[f.name for f in schema.fields]]

    dealt = rows.groupBy("_bucket").cogroup(offsets.groupBy("_at")).applyInPandas(permute, schema)
    return dealt.select(
        F.col("_id").alias(id_col),
        F.col("_text").alias(text_col),
        F.col("_bucket").alias("bucket"),
        F.col("_position").alias("position"),
        F.pmod("_position", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_position") / F.lit(n_shards)).cast("long").alias("slot"),
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """Writes what shuffle_shards gives as Parquet, one folder for each shard; within a file the rows stand in slot order.

    A shard has a file for each task that holds some of its rows; ordered by the first slot, the files of a shard are the shard
    in order, because buckets are ranges of positions.
    """
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark, path: str, shard: int) -> Iterator:
    """Rows of one shard in slot order, as an iterator."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").toLocalIterator()
