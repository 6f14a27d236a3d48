"""Sharding by jump consistent hashing.

A row's shard depends on its stable key and the number of shards alone.  The
jump hash walks the few shard counts at which the key would have moved (about
ln(shards) steps of a 64-bit linear congruential generator) and needs no ring
table.  With one more shard, a key either keeps its shard or goes to the new
one, and only 1 / (shards + 1) of the keys go.

Slots number the rows of a shard without gaps.  They come from a range
partitioning on (shard, id, content) with counts per range partition, so a
shard of any size is numbered by many tasks.

Defined cases: a null text counts as empty (size 1, crc32 of nothing, which is
0); a null id is a key of its own; repeated rows share a shard and take a slot
each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.position import with_position
from .common import read, text_bytes

#: Multiplier and increment of the generator.
_MULTIPLIER, _INCREMENT = np.uint64(2862933555777941757), np.uint64(1)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards`` shards."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard, jump = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.flatnonzero(jump < shards)
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _MULTIPLIER + _INCREMENT
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", shard_col: str = "shard",
           grown_col: str | None = None) -> DataFrame:
    """Add the shard of every row's key (and, as ``grown_col``, its shard if there were one more)."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    @F.pandas_udf("int")
    def grown(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards + 1).astype(np.int32))

    # the key's 64 bits are mixed first: consecutive ids are no random draws
    key = F.xxhash64(F.col(f"`{id_col}`"))
    out = df.withColumn(shard_col, place(key))
    return out.withColumn(grown_col, grown(key)) if grown_col else out


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Write ``df`` as Parquet with one folder per shard; large shards are split over several files."""
    (assign(df, shards, id_col, "_cm_shard").repartition("_cm_shard", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
     .withColumnRenamed("_cm_shard", "shard" if "shard" not in df.columns else "_cm_shard")
     .write.partitionBy("shard" if "shard" not in df.columns else "_cm_shard").mode("overwrite").parquet(path))


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    raw = F.coalesce(text_bytes(text_col), F.lit("").cast("binary"))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(slim, shards, "doc_id", "shard", "grown_shard")
    numbered = with_position(placed, ["doc_id", "text_crc32", "size"], ["shard"], pos_col="slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
                           "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents"))
