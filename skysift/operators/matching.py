"""Nearest-in-time matching, interpolation on grids, and pairing by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import row_ids


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: str, right_order: str, width: float) -> DataFrame:
    """Each row of ``left`` as _l, with the last row of ``right`` not after it as _before and the first not before it as _after.

    ``right`` has at most one row per place and key. No pairs are made: both tables are laid in one order, in ranges of ``width``,
    and each row sees the last and the next row of the other; the ranges' own last and first rows, a row per range,
    tell what lies beyond. Rows with a null or no place are beside nothing.
    """
    cell = lambda x: F.floor(F.col(x) / width).cast("long")
    own = left.select(*by, F.col(left_order).alias("_t"), cell(left_order).alias("_cell"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_l"))
    other = right.where(F.col(right_order).isNotNull()).select(*by, F.col(right_order).alias("_t"), cell(right_order).alias("_cell"), F.lit(0).alias("_kind"), F.struct(*right.columns).alias("_r"))
    both = own.unionByName(other, allowMissingColumns=True)
    up = Window.partitionBy(*by, "_cell").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_cell").orderBy(F.desc("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_before": F.last("_r", ignorenulls=True).over(up), "_after": F.last("_r", ignorenulls=True).over(down)}).where("_kind = 1")
    # beyond the range: the last and first row of each range that has any, and ranges in order
    ends = other.groupBy(*by, "_cell").agg(F.max_by("_r", "_t").alias("_last"), F.min_by("_r", "_t").alias("_first"))
    ends = ends.unionByName(own.where("_cell is not null").select(*by, "_cell").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*by, "_cell").agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"), F.max_by("_first", F.col("_first").isNotNull()).alias("_first"))
    cells = Window.partitionBy(*by).orderBy("_cell")
    back = Window.partitionBy(*by).orderBy(F.desc("_cell"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_cell", F.last("_last", ignorenulls=True).over(past(cells)).alias("_earlier"), F.last("_first", ignorenulls=True).over(past(back)).alias("_later"))
    joined = both.join(ends, [*by, "_cell"], "left")
    return joined.select(*by, "_l", F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))


def earlier(df: DataFrame, by: Sequence[str], order: str, values: dict[str, Column], width: float, then: Sequence[str] = ()) -> DataFrame:
    """``df`` with the last value before each row, null ones passed over, of each named expression; ``then`` makes the order total.

    Rows are laid in ranges of ``width``; a row per range tells what earlier ranges end with. Rows without a place see nothing.
    """
    rows = df.withColumns({f"_v_{k}": v for k, v in values.items()} | {"_cell": F.floor(F.col(order) / width).cast("long")})
    inside = Window.partitionBy(*by, "_cell").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.struct(order, *then)))
    ends = rows.where("_cell is not null").groupBy(*by, "_cell").agg(*(last(k).alias(f"_e_{k}") for k in values))
    cells = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ends.select(*by, "_cell", *(F.last(f"_e_{k}", ignorenulls=True).over(cells).alias(f"_e_{k}") for k in values))
    rows = rows.withColumns({f"_i_{k}": F.last(f"_v_{k}", ignorenulls=True).over(inside) for k in values}).join(ends, [*by, "_cell"], "left")
    found = lambda k: F.when(F.col("_cell").isNotNull(), F.coalesce(f"_i_{k}", f"_e_{k}"))
    return rows.select(*df.columns, *(found(k).alias(k) for k in values))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, right_id: str, width: float = 3600.0) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` nearest in time and equal in ``by``; rows without any are left out.

    Of equally near ones the earlier wins, of simultaneous ones that with the smallest id.
    """
    cols = [c for c in right.columns if c not in by]
    once = right.groupBy(*by, right_time).agg(F.min_by(F.struct(*(c for c in cols if c != right_time)), F.col(right_id)).alias("_o"))
    both = beside(left, once.select(*by, right_time, "_o.*"), by, left_time, right_time, width)
    back, on = F.col(f"_l.{left_time}") - F.col(f"_before.{right_time}"), F.col(f"_after.{right_time}") - F.col(f"_l.{left_time}")
    pick = F.when(F.col("_after").isNull() | (back <= on), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    return both.withColumn("_r", pick).where("_r is not null").select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in cols if c not in left.columns))


def interpolate(queries: DataFrame, x: str, grid: DataFrame, gx: str, gy: str, out: str, width: float = 64.0) -> DataFrame:
    """``queries`` with the linear interpolation of a grid at ``x``; outside the grid, its end values; null for a null ``x``.

    ``width`` is about as wide as many grid points lie; repeated grid places count with their least value.
    """
    points = grid.groupBy(F.col(gx).cast("double").alias("_gx")).agg(F.min(gy).alias("_gy"))
    q = beside(queries.withColumn("_q", F.col(x).cast("double")), points, [], "_q", "_gx", width)
    lo, hi = F.coalesce("_before", "_after"), F.coalesce("_after", "_before")
    q = q.withColumns({"_a": lo, "_b": hi}).select("_l.*", "_a", "_b")
    part = F.when(F.col("_b._gx") > F.col("_a._gx"), (F.col("_q") - F.col("_a._gx")) / (F.col("_b._gx") - F.col("_a._gx"))).otherwise(0.0)
    y = F.when(F.col("_q").isNotNull(), F.col("_a._gy") + (F.col("_b._gy") - F.col("_a._gy")) * part)
    return q.withColumn(out, y).select(*queries.columns, out)


def uniform_grid(queries: DataFrame, x: Column, lo: float, step: float, values: DataFrame, out: str) -> DataFrame:
    """Interpolation on an even grid (k, value): by position, as an equi-join on the cell's number."""
    cell = F.floor((x - lo) / step).cast("long")
    pairs = values.select("k", "value", F.lead("value").over(Window.orderBy("k")).alias("next")) if "next" not in values.columns else values
    got = queries.withColumn("_k", cell).join(F.broadcast(pairs.withColumnRenamed("k", "_k")), "_k")
    return got.withColumn(out, F.col("value") + (F.col("next") - F.col("value")) * ((x - lo) / step - F.col("_k"))).drop("_k", "value", "next")


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of one table with the k-th of the other, until either ends."""
    return row_ids(left, left_order, name="k").join(row_ids(right, right_order, name="k"), "k")


def strided(windows: DataFrame, signals: DataFrame, window_order: str, signal_order: str) -> DataFrame:
    """Signals with every step-th window, step being the ratio of their numbers; with fewer windows than signals, as many signals as windows."""
    n, m = windows.count(), signals.count()
    step = max(1, n // m) if m else 1
    w = row_ids(windows, window_order, name="k").where(F.col("k") % step == 0).withColumn("k", F.floor(F.col("k") / step))
    return w.join(row_ids(signals, signal_order, name="k"), "k")
