"""Sharding by jump consistent hashing: no ring table, and one more shard moves 1/(n+1) of the rows.

The shard follows from the key and the number of shards alone, so equal keys share a shard however
often they occur. Slots number each shard's rows from 0 without gaps: rows are counted by partition
and shard first, and each partition then numbers its own rows from its offset, so that no shard is
ever sorted or gathered in one task.

Integer keys are hashed as they are, any other by the 64-bit hash of its text; the key comes back in its own type (integers as long).
Nulls: a null key hashes as 0; a null text has 0 bytes (size 1) and the CRC-32 of nothing, 0.
Repeated rows each get a slot of their own. An empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import shared_dir

#: Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key in [0, shards)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(todo):
            k = key[todo] * np.uint64(MULTIPLIER) + np.uint64(1)
            key[todo] = k
            ahead = ((shard[todo] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            go = ahead < shards
            todo = todo[go]
            shard[todo] = ahead[go]
    return shard


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    whole = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    own = F.col(f"`{key}`").cast("long") if whole else F.col(f"`{key}`")
    kind = "long" if whole else docs.schema[key].dataType.simpleString()
    stable = own if whole else F.when(own.isNotNull(), F.xxhash64(own.cast("string")))
    light = docs.select(
        own.alias(key),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(stable, F.lit(0)).alias("stable"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(3).to_numpy(zero_copy_only=False)
            now, grown = jump_hash(k, shards), jump_hash(k, shards + 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(now.astype(np.int32)), pa.array(grown.astype(np.int32))],
                                             names=[key, "size", "text_crc32", "shard", "grown_shard"])

    placed = light.mapInArrow(place, f"`{key}` {kind}, size long, text_crc32 long, shard int, grown_shard int")
    # A reliable checkpoint: both passes below see the same rows in the same partitions, also after a lost executor.
    shared_dir(spark)
    placed = placed.checkpoint().withColumn("part", F.spark_partition_id())
    counts = placed.groupBy("part", "shard").count()
    # One row for each task and shard: its size follows the number of tasks, not of rows.
    before = counts.selectExpr("part", "shard", "sum(count) over (partition by shard order by part) - count as base")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for b in batches:
            s = b.column("shard").to_numpy()
            order = np.argsort(s, kind="stable")
            n = np.bincount(s, minlength=shards)
            local = np.empty(len(s), np.int64)
            local[order] = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])

    numbered = placed.mapInArrow(number, f"`{key}` {kind}, size long, text_crc32 long, shard int, grown_shard int, part int, local long")
    return numbered.join(before, ["part", "shard"]).select(
        F.col(f"`{key}`"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("local")).alias("slot"), "grown_shard")
