"""Exact ranks and running totals over a whole table, without a window on one partition.

Rows are dealt by ranges of their total order and written with the number of their range; the
ranges' totals (a row each) become offsets, which are broadcast; windows then run within
ranges. Where equal values count together they are summed first, so that a value is one row
however many rows have it, and its running sum is joined back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import fixed


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = True, then: tuple[str, ...] = (), ties: bool = False) -> DataFrame:
    """``df`` with running sums of expressions over the whole table in one order.

    With ``ties`` a row's sum takes in all rows with an equal value of ``order``;
    otherwise ``then`` must make the order total. Null orders come last.
    """
    if ties:
        values = df.groupBy(F.col(order).alias("_value")).agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
        upto = running(values, "_value", {f"_to_{k}": f"`{k}`" for k in sums}, descending).select("_value", *(F.col(f"_to_{k}").alias(k) for k in sums))
        return df.join(upto, F.col(order).eqNullSafe(F.col("_value"))).select(*(df[c] for c in df.columns), *sums)
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    parts = df.withColumns({f"_{k}": F.expr(e) for k, e in sums.items()})
    parts = fixed(parts.repartitionByRange(by, *then).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inner = Window.partitionBy("_range").orderBy(by, *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(totals), "_range")
    return out.select(*df.columns, *((F.sum(f"_{k}").over(inner) + F.col(f"_b_{k}")).alias(k) for k in sums))


def row_ids(df: DataFrame, order: str, then: tuple[str, ...] = (), descending: bool = False, name: str = "row_id") -> DataFrame:
    """``df`` with consecutive numbers from 0 in a total order."""
    return running(df, order, {name: "1L"}, descending, then).withColumn(name, F.col(name) - 1)


def counts_at_least(stats: DataFrame, thresholds: DataFrame, stat: str = "detection_statistic", threshold: str = "threshold") -> DataFrame:
    """``thresholds`` with nb: how many rows of ``stats`` are at least the threshold."""
    union = thresholds.select(F.col(threshold).alias("_x"), F.lit(0).alias("_one"), F.struct(*thresholds.columns).alias("_row")).unionByName(
        stats.select(F.col(stat).alias("_x"), F.lit(1).alias("_one")), allowMissingColumns=True
    )
    return running(union, "_x", {"nb": "cast(_one as bigint)"}, ties=True).where("_one = 0").select("_row.*", "nb")


def kth_largest(df: DataFrame, column: str, k: int, compat: bool = False) -> DataFrame:
    """One row: the k-th largest value; null for k = 0, or the least value with ``compat``."""
    if k <= 0:
        return df.agg((F.min(column) if compat else F.lit(None).cast("double")).alias("threshold"))
    numbered = running(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column, {"_rank": "_n"})
    return numbered.agg(F.max(F.when(F.col("_rank") >= k, F.col(column))).alias("threshold"))

