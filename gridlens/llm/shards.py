"""Sharding by jump consistent hashing: a key and the shard count decide, without a ring table.

Appending a shard moves 1 / (n + 1) of the keys, all of them into the new shard. Rows with equal keys share a shard,
null keys too; other columns do not matter to it, and an empty table gives an empty result. Rows of a shard are numbered from 0 without gaps in no single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.frames import gapless_rank

SLOT_PARTS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: each key jumps ahead until it leaves the range."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keys = keys.astype(np.uint64)
    held, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        held[live] = ahead[live]
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        stride = float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((held[live] + 1) * stride).astype(np.int64)
        live = live[ahead[live] < shards]
    return held.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a column's values; the key is hashed first, so that its own pattern does not show. Null is a key."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64).copy(), shards))

    return jump(F.xxhash64(key))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int = SLOT_PARTS) -> DataFrame:
    """Per row: key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard (with one more shard).

    A null text has no bytes: size 8, checksum 0. Rows alike in key, size and checksum are numbered in any order.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    spread = F.struct("doc_id", "size", "text_crc32")
    placed = gapless_rank(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], spread, parts, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
