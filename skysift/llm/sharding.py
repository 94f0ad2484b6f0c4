"""Placement of rows on shards by a permutation-filled lookup table, in SQL functions only.

Every shard has its own permutation of the slots of a table of prime size, given
by an offset and a step from hashes of its name. The shards take turns, each
claiming the first slot of its permutation that is still free, until the table is
full; so shards have equal numbers of slots but one, and when a shard comes or goes
few slots change hands. The table has ``size`` rows whatever the input, is
broadcast, and gives each row its shard by one lookup: no shuffle.

Defined results: a null key is placed as the empty string; equal keys land together;
an empty table gives an empty table; other columns pass through, but those
called ``slot`` or ``shard`` are replaced, also where one is the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._store import unused

#: A prime far above 100 times the number of shards keeps their shares even within 1 %.
TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    at, step = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "little") % size)
        step.append(int.from_bytes(h[8:16], "little") % (size - 1) + 1)
    owner, claimed = [-1] * size, 0
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            claimed += 1
            if claimed == size:
                return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard): ``size`` rows."""
    listed = ",".join(map(str, fill(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "owner")).select(
        "slot", F.col("owner").cast("int").alias("shard")
    )


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with the columns slot and shard."""
    table = F.broadcast(lookup_table(rows.sparkSession, shards, size))
    slot = unused(rows, "_slot")
    rows = rows.withColumn(slot, slot_of(F.col(key), size)).drop("slot", "shard").withColumnRenamed(slot, "slot")
    return rows.join(table, "slot", "left").select(*(c for c in rows.columns if c != "slot"), "slot", "shard")


def write(placed: DataFrame, path: str, salts: int = 8) -> None:
    """Write a folder per shard; each is dealt over ``salts`` tasks, so a large shard is never one task's."""
    placed.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(salts))).write.partitionBy("shard").parquet(path)
