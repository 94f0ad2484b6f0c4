"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(modulus))


def usable(labels: DataFrame, column: str, modulus: int, held: int, learn: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the ids outside the held-out fold; several labels of an id count as their majority, ties as 1."""
    rows = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    return rows.where((remainder(F.col("id"), modulus) != held) if learn else (remainder(F.col("id"), modulus) == held))


def sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows (id, label), those with the smallest hashes of the id."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)
