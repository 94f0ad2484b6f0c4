"""Event and injection tables: reading by declared columns, writing, sampling, joining many files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.ranks import row_ids
from .store import folder


def read(spark: SparkSession, path: str | list[str], columns: Iterable[str], optional: dict[str, str] | None = None) -> DataFrame:
    """The declared columns only; a missing one is an error, missing metadata (``optional``: name and type) is null."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    extra = [F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in (optional or {}).items()]
    return df.select(*columns, *extra)


def write(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Rows under ``path``/rows, one row of metadata with the number of rows beside them."""
    df.write.parquet(f"{path}/rows")
    n = df.sparkSession.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("length"))
    n.select(*(F.lit(v).alias(k) for k, v in (metadata or {}).items()), "length").write.parquet(f"{path}/metadata")


def near(df: DataFrame, start: float | None, stop: float | None, left_pad: float, shifts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Injections of which any part may lie in [start, stop], both inclusive, and of the given shifts.

    The bounds are on the stored column itself, so they reach the scan.
    """
    if start is not None:
        df = df.where(F.col("injection_time") >= start - left_pad)
    if stop is not None:
        df = df.where(F.col("injection_time") <= stop + left_pad)
    if shifts is not None:
        if len({len(s) for s in shifts}) > 1:
            raise ValueError("shifts of different dimensions")
        df = df.where(F.col("shift").isin(*(F.array(*(F.lit(float(x)) for x in s)) for s in shifts)))
    return df


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the smallest hashes of ``key`` and the seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n draws of rows, in order of ``draw``; every draw is a hash of its number and the seed."""
    rows = row_ids(df, key)
    total = df.count()
    if not total:
        raise ValueError("nothing to draw from")
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (hashed % total).alias("row_id"))
    return draws.join(rows, "row_id")


def union(tables: Sequence[DataFrame], doubles: Sequence[str]) -> DataFrame:
    """All rows of all tables, the named columns as doubles."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumns({c: F.col(c).cast("double") for c in doubles})


def merge_metadata(df: DataFrame, by: str, sums: Sequence[str], equal: Sequence[str]) -> DataFrame:
    """One row per ``by``: sums of some fields; others must agree where they aren't null, else the query fails."""
    same = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit(f"{c} differs"))).alias(c)
    return df.groupBy(by).agg(*(F.sum(c).alias(c) for c in sums), *(same(c) for c in equal))


def schema(parameters: dict[str, str], waveforms: Sequence[str] = (), metadata: dict[str, str] | None = None) -> T.StructType:
    """A table's type from columns by kind: scalars, sample arrays, one value per table."""
    fields = [f"`{n}` {k}" for n, k in parameters.items()] + [f"`{n}` array<float>" for n in waveforms] + [f"`{n}` {k}" for n, k in (metadata or {}).items()]
    return T.StructType.fromDDL(", ".join(fields))


def names_to_segments(names: DataFrame, column: str) -> DataFrame:
    """(column, start, stop, ok): the interval in a file's name; names without one are not ok."""
    pattern = r"(\d{10}\.*\d*)-(\d+\.*\d*)"
    t0 = F.regexp_extract(column, pattern, 1).try_cast("double")
    length = F.regexp_extract(column, pattern, 2).try_cast("double")
    return names.select(column, t0.alias("start"), (t0 + length).alias("stop"), t0.isNotNull().alias("ok"))


def series_written(series: DataFrame, path: str) -> DataFrame:
    """Write a series by slide and give the index of its keys."""
    series.write.partitionBy("slide").parquet(path)
    return series.sparkSession.read.parquet(path).groupBy(F.col("slide").cast("long")).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def event_record(time: Column) -> list[Column]:
    """Whole seconds and the nanoseconds beyond, of a time in seconds."""
    return [F.floor(time).cast("long").alias("end_time"), F.floor((time - F.floor(time)) * 1e9).cast("long").alias("end_time_ns")]


def round_trip(df: DataFrame, form: str, **options) -> DataFrame:
    """Write in a format and read back with the same schema."""
    path = folder(df.sparkSession, form)
    df.write.options(**options).format(form).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(form).load(path)


def latest(rows: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """Of the rows of each key the one with the largest version (map-side combined)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("_r")).select("_r.*")
