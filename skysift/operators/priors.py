"""Populations: draws by inverse distribution functions of hashed uniforms, and grids of injections and time slides."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import fixed
from .ranks import running
from .sampling import accept_until, uniform as hashed_uniform

#: A distribution: from a uniform number in [0, 1) to a value.
Distribution = Callable[[Column], Column]
#: A hook: from a table to a table.
Transform = Callable[[DataFrame], DataFrame]


def draw(rows: DataFrame, key: str, prior: dict[str, Distribution], seed: int, convert: Transform | None = None, keep: Column | None = None) -> DataFrame:
    """``rows`` with a column per parameter, in order, so that later ones may depend on earlier ones.

    ``convert`` adds what follows from the drawn parameters; of the rows those stay that ``keep`` holds for.
    """
    for name, f in prior.items():
        rows = rows.withColumn(name, f(hashed_uniform(F.col(key), name, str(seed))))
    rows = convert(rows) if convert is not None else rows
    return rows.where(keep) if keep is not None else rows


def uniform(lo: float | Column, hi: float | Column) -> Distribution:
    return lambda u: lo + u * (hi - lo)


def sine() -> Distribution:
    """An angle in [0, pi] with density sin(x) / 2."""
    return lambda u: F.acos(1 - 2 * u)


def cosine() -> Distribution:
    """A declination with density cos(x) / 2."""
    return lambda u: F.asin(2 * u - 1)


def power_law(alpha: float, lo: float, hi: float | Column) -> Distribution:
    """Density x**alpha on [lo, hi]; alpha isn't -1."""
    a = alpha + 1
    top = F.pow(hi if isinstance(hi, Column) else F.lit(hi), F.lit(a))
    return lambda u: F.pow(lo**a + u * (top - lo**a), F.lit(1 / a))


def log_uniform(lo: float, hi: float) -> Distribution:
    return lambda u: lo * F.pow(F.lit(hi / lo), u)


def triangular(lo: float, mode: float, hi: float) -> Distribution:
    cut = (mode - lo) / (hi - lo)
    return lambda u: F.when(u < cut, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mode)))


def normal(mu: float, sigma: float) -> Distribution:
    """By a rational approximation of the quantile and one Newton step."""
    from ..functions.columns import normal_cdf

    def f(u: Column) -> Column:
        p = F.greatest(F.least(u, F.lit(1 - 1e-9)), F.lit(1e-9))
        # fixed values: Abramowitz and Stegun 26.2.23
        t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
        z = F.when(p < 0.5, -z).otherwise(z)
        return mu + sigma * (z - (normal_cdf(z) - p) * F.exp(z * z / 2) * math.sqrt(2 * math.pi))

    return f


def log_normal(mu: float, sigma: float) -> Distribution:
    base = normal(mu, sigma)
    return lambda u: F.exp(base(u))


def in_volume(hi: float) -> Distribution:
    """A distance uniform in a Euclidean ball's volume."""
    return lambda u: hi * F.pow(u, F.lit(1 / 3))


def tabulated(values: Sequence[float], cumulated: Sequence[float]) -> Distribution:
    """Values by a table of how much of the distribution lies below each, which is searched by halving; between two, linearly.

    ``cumulated`` begins with 0 and doesn't fall; what it ends with counts as all. The table is sent with the tasks, so it should be of fixed size.
    """
    x, c = np.asarray(values, np.float64), np.asarray(cumulated, np.float64)
    if len(x) < 2 or len(x) != len(c) or c[0] != 0 or (np.diff(c) < 0).any() or not c[-1] > 0:
        raise ValueError("a table needs two values at least, and sums that begin with 0 and don't fall")

    @F.pandas_udf("double")
    def f(u: pd.Series) -> pd.Series:
        at = u.to_numpy(np.float64) * c[-1]
        below = np.clip(np.searchsorted(c, at, "right") - 1, 0, len(c) - 2)
        width = c[below + 1] - c[below]
        part = np.divide(at - c[below], width, out=np.zeros(len(at)), where=width > 0)
        return pd.Series(x[below] + (x[below + 1] - x[below]) * part)

    return f


def in_universe(spark: SparkSession, farthest: float, of: str = "z", dilated: bool = True) -> Distribution:
    """A redshift, or with ``of="distance"`` a luminosity distance, uniform in comoving volume up to a redshift on the grid; by default in time, too, at the source."""
    from . import cosmology

    table = cosmology.grid(spark).where(F.col("z") <= farthest + 1e-9).select("k", of, F.col("volume" if dilated else "comoving").alias("c")).toPandas().sort_values("k")
    return tabulated(table[of], table["c"])


def until_accepted(spark: SparkSession, quota: int, make: Transform, accepted: str, most: int) -> DataFrame:
    """Draws in the order of their id (from 0 on), rejected ones too, up to and with the one that fills the quota; so all that were drawn are counted.

    ``make`` makes a row with the flag ``accepted`` of every id of a table, by hashes of the id, so what a draw gives doesn't depend on rounds. The first round has as many as
    are wanted; what the next ones have follows from the share accepted so far. Rounds are written once. More than ``most`` draws are an error.
    """
    done, got, size = 0, 0, quota
    out = make(spark.range(0)).limit(0)
    while got < quota:
        size = min(size, most - done)
        if size <= 0:
            raise ValueError(f"of {done} draws only {got} are accepted, {quota} are wanted")
        part = fixed(make(spark.range(done, done + size)), "draws")
        out = out.unionByName(part) if done else part
        got += part.where(F.col(accepted)).count()
        done += size
        size = math.ceil(1.1 * (quota - got) * done / max(got, 1))
    return accept_until(out, accepted, quota, "id")


def injection_grid(segments: DataFrame, spacing: float, buffer: float, duration: float, max_shift: float) -> DataFrame:
    """(segment's columns, k, t): times from start + buffer on, before stop - shift - buffer, half a duration's room added."""
    b, step = buffer + duration // 2, spacing + duration
    n = F.ceil((F.col("stop") - max_shift - b - (F.col("start") + b)) / step).cast("long")
    rows = segments.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("t", F.col("start") + b + F.col("k") * step)


def timeslides(segments: DataFrame, key: str, kernel: float, livetime: float) -> DataFrame:
    """(key, shift, used): shifts 1, -1, 2, -2, ... of all segments in turn until the livetime is used up; the last one is cut.

    Where the livetime is more than all shifts give, all with room are used.
    """
    room = F.greatest(F.col("stop") - F.col("start") - kernel, F.lit(0.0))
    longest = segments.agg(F.max(F.ceil(room))).first()[0] or 0
    most = 1
    while most < longest:  # the livetime of shifts up to ``most``, both ways, in closed form
        n = F.least(F.floor(room), F.lit(most)).cast("double")
        if (segments.agg(F.sum(2 * (room * n - n * (n + 1) / 2))).first()[0] or 0.0) >= livetime:
            break
        most = min(2 * most, int(longest))
    j = segments.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * most - 1).cast("long"))))
    size = F.expr("j div 2 + 1")
    rows = j.withColumn("shift", F.when(F.col("j") % 2 == 0, size).otherwise(-size))
    rows = rows.withColumn("used", F.greatest(room - F.abs("shift"), F.lit(0.0))).where("used > 0")
    rows = running(rows, "j", {"total": "used"}, descending=False, then=("start", key))
    before = F.col("total") - F.col("used")
    return rows.where(before < livetime - 0.001).withColumn("used", F.least("used", livetime - before))


def mass_grid(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(k.alias("k"), (lo * F.pow(F.lit(hi / lo), k / (n - 1))).alias("log_mass"), (lo + k * (hi - lo) / (n - 1)).alias("linear_mass"))
