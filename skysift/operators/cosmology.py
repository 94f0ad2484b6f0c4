"""Distances and volumes of a flat universe of matter and a cosmological constant, on an even grid of redshifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .matching import interpolate, uniform_grid

#: The speed of light in km/s; the Hubble constant in km/s/Mpc and the share of matter of the 2015 Planck results.
LIGHT, HUBBLE, MATTER = 299792.458, 67.74, 0.3075
STEPS, FARTHEST = 10_000, 2.0


def grid(spark: SparkSession, farthest: float = FARTHEST, steps: int = STEPS) -> DataFrame:
    """(k, z, distance, rate, volume, comoving) of ``steps`` + 1 redshifts: luminosity distance in Mpc; Mpc**3 per steradian and unit of z at z,
    time dilated, and up to z with and without the dilation.

    Comoving distance and volumes are summed by trapezoids; the table has a fixed size.
    """
    step = farthest / steps
    w = Window.orderBy("k")
    trapezoids = lambda df, x, out: df.withColumn("_s", F.coalesce((F.col(x) + F.lag(x).over(w)) / 2 * step, F.lit(0.0))).withColumn(out, F.sum("_s").over(w)).drop("_s")
    rows = spark.range(steps + 1).select(F.col("id").alias("k"), (F.col("id") * step).alias("z"))
    rows = rows.withColumn("_d", LIGHT / HUBBLE / F.sqrt(MATTER * F.pow(1 + F.col("z"), F.lit(3)) + (1 - MATTER)))
    rows = trapezoids(rows, "_d", "_c").withColumn("_u", F.col("_c") * F.col("_c") * F.col("_d")).withColumn("rate", F.col("_u") / (1 + F.col("z")))
    return trapezoids(trapezoids(rows, "rate", "volume"), "_u", "comoving").select("k", "z", (F.col("_c") * (1 + F.col("z"))).alias("distance"), "rate", "volume", "comoving")


def at_redshift(df: DataFrame, z: Column, value: str, out: str, farthest: float = FARTHEST, steps: int = STEPS) -> DataFrame:
    """``df`` with the grid's ``value`` at a redshift of at most ``farthest``, by position on the even grid."""
    table = grid(df.sparkSession, farthest, steps)
    pairs = table.select("k", F.col(value).alias("value"), F.lead(value).over(Window.orderBy("k")).alias("next"))
    return uniform_grid(df, z, 0.0, farthest / steps, pairs.withColumn("next", F.coalesce("next", "value")), out)


def redshift_at(df: DataFrame, distance: str, out: str) -> DataFrame:
    """``df`` with the redshift of a luminosity distance; the distances are no even grid, so it is looked up between its neighbours."""
    return interpolate(df, distance, grid(df.sparkSession), "distance", "z", out, width=64.0)


def volume_between(df: DataFrame, z0: Column, z1: Column, dec0: Column, dec1: Column, out: str) -> DataFrame:
    """Mpc**3 between two redshifts and two declinations."""
    from .sensitivity import solid_angle

    both = at_redshift(at_redshift(df, z0, "volume", "_v0"), z1, "volume", "_v1")
    return both.withColumn(out, (F.col("_v1") - F.col("_v0")) * solid_angle(dec0, dec1)).drop("_v0", "_v1")


#: The same grid in SQL, as the table cosmos.
SQL = f"""
, cosmos0 as (select k, k * {FARTHEST / STEPS!r}::double as z, {LIGHT!r}::double / {HUBBLE!r}::double / sqrt({MATTER!r}::double * pow(1 + k * {FARTHEST / STEPS!r}::double, 3) + {1 - MATTER!r}::double) as d from range(0, {STEPS + 1}) t(k)),
cosmos1 as (select *, sum(s) over (order by k) as c from (select *, coalesce((d + lag(d) over (order by k)) / 2 * {FARTHEST / STEPS!r}::double, 0) as s from cosmos0)),
cosmos2 as (select k, z, c * (1 + z) as distance, c * c * d / (1 + z) as v from cosmos1),
cosmos3 as (select k, z, distance, v as rate, sum(s) over (order by k) as volume from (select *, coalesce((v + lag(v) over (order by k)) / 2 * {FARTHEST / STEPS!r}::double, 0) as s from cosmos2)),
cosmos as (select *, coalesce(lead(z) over (order by k), z) as z1, coalesce(lead(distance) over (order by k), distance) as distance1, coalesce(lead(volume) over (order by k), volume) as volume1, coalesce(lead(rate) over (order by k), rate) as rate1 from cosmos3)
"""
