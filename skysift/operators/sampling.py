"""Random choices that hashes of stable ids make, so that a recomputation makes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hashed(*parts: Column | str) -> Column:
    """48 bits of the MD5 of the parts, joined by ``|``."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return hashed(*parts) / F.lit(float(1 << 48))


def contiguous_runs(df: DataFrame, file: str, order: str, draws: int, size: int) -> DataFrame:
    """For each draw a file, as likely as it has rows, and a run of ``size`` rows of it.

    A draw's file is found by counting the files that begin at or before the picked row, over ranges as all ranks are.
    """
    from .ranks import counts_at_least, row_ids, running

    files = running(df.groupBy(file).agg(F.count(F.lit(1)).alias("n")), file, {"upto": "n", "number": "1L"}, descending=False)
    # numbers over the whole table, less where the file begins
    rows = row_ids(df.withColumn("_place", F.struct(file, order)), "_place", name="_row").drop("_place")
    rows = rows.join(files.select(file, (F.col("upto") - F.col("n")).alias("_begin")), file).withColumn("row_id", F.col("_row") - F.col("_begin")).drop("_row", "_begin")
    total = df.count()
    asked = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (-(hashed(F.col("id"), "file") % total)).alias("pick"), hashed(F.col("id"), "row").alias("h"))
    begun = files.select((F.col("n") - F.col("upto")).alias("start"))
    runs = counts_at_least(begun, asked, "start", "pick").join(files, F.col("nb") == F.col("number"))
    runs = runs.select("draw", file, (F.col("h") % F.greatest(F.col("n") - size + 1, F.lit(1))).alias("start"))
    wanted = runs.select("draw", file, F.explode(F.sequence("start", F.col("start") + size - 1)).alias("row_id"))
    return wanted.join(rows, [file, "row_id"])


def batches_of_chunk(df: DataFrame, chunk: str, key: str, batches: int, size: int) -> DataFrame:
    """For each chunk ``batches`` random choices of ``size`` of its rows."""
    many = df.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    by = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("batch").cast("string")))
    return many.withColumn("_r", F.row_number().over(Window.partitionBy(chunk, "batch").orderBy(by, key))).where(F.col("_r") <= size).drop("_r")


def accept_until(df: DataFrame, accepted: str, quota: int, order: str) -> DataFrame:
    """Candidates in order up to and with the one that fills the quota of accepted ones."""
    from .ranks import running

    marked = running(df.withColumn("_one", F.col(accepted).cast("long")), order, {"_sum": "_one"}, descending=False)
    return marked.where(F.col("_sum") - F.col("_one") < quota).drop("_one", "_sum")
