"""Sharding by a permutation-filled lookup table (built-in functions only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, large against the number of shards, and so the bound of what is broadcast.
TABLE_SIZE = 65_537


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that owns it.

    Each shard prefers the slots in its own order, offset + k * skip modulo the prime
    size. The shards take turns, and at its turn a shard claims the first slot of its
    order that is still free. Shares differ by one slot at most, and taking a shard
    away moves few slots between the others.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most one for each slot")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime")
    at = [_digest(f"offset:{s}") % size for s in shards]
    skip = [_digest(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def place(df: DataFrame, shards: list[str], key: str = "doc_id", text: str = "text", size: int = TABLE_SIZE, seed: int = 0) -> DataFrame:
    """Add ``slot`` and ``shard``: a hash of the key picks a slot, the broadcast table its shard.

    Rows with the same key go to the same shard; rows whose key is null are placed
    by their text, so that they spread. Columns named slot or shard are replaced.
    No shuffle: the table has ``size`` rows whatever the input.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, size)
    table = spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(owner)], "slot int, shard string")
    spread = F.coalesce(F.xxhash64(F.lit(seed), F.col(key)) if text not in df.columns else F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), F.col(text))).otherwise(F.xxhash64(F.lit(seed), F.col(key))))
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(spread, F.lit(size)).cast("int"))
    return placed.join(F.broadcast(table), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: list[str], **options) -> None:
    """Write one folder of Parquet files for each shard."""
    place(df, shards, **options).repartition("shard", F.pmod(F.col("slot"), F.lit(16))).write.partitionBy("shard").parquet(path)
