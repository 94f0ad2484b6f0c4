"""Scalar functions of columns: masses, frames, times, bits, closed-form densities."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

# What a year and a month are, by use.
YEAR_FAR = 31556952.0
YEAR_VOLUME = 365.25 * 86400
YEAR_MONITOR = 365.0 * 86400
MONTH = 30 * 86400.0


def chirp_mass(m1: Column, m2: Column) -> Column:
    return F.pow(F.pow(m1 * m2, F.lit(3)) / (m1 + m2), F.lit(0.2))


def component_masses(chirp: Column, ratio: Column) -> tuple[Column, Column]:
    """From chirp mass and ratio m2 / m1."""
    m1 = chirp * F.pow(1 + ratio, F.lit(0.2)) / F.pow(ratio, F.lit(0.6))
    return m1, m1 * ratio


def source_frame(mass: Column, redshift: Column) -> Column:
    return mass / (1 + redshift)


def detector_frame(mass: Column, redshift: Column) -> Column:
    return mass * (1 + redshift)


def network(snrs: Column) -> Column:
    """Root of the sum of squares of an array."""
    return F.sqrt(F.aggregate(snrs, F.lit(0.0), lambda a, x: a + x * x))


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    """All of the columns within their ranges, both ends included."""
    return reduce(and_, (F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()), F.lit(True))


def analyzable(start: Column, stop: Column, shifts: Column, psd_length: float) -> Column:
    return (stop - start) - F.array_max(shifts) - psd_length > 0


def ready(state: Column) -> Column:
    """Bits 0 and 1 are set in all samples."""
    return F.forall(state, lambda v: v.bitwiseAND(3) == 3)


def ceil_div(x: Column, y: Column) -> Column:
    return (F.floor((x - 1) / y) + 1).cast("long")


def statement_time(line: Column) -> Column:
    """The time at the start of a log line, with a decimal comma."""
    return F.to_timestamp(F.translate(F.substring(line, 1, 23), ",", "."))


def frame_name(name: Column) -> list[Column]:
    """Prefix, start and duration of a frame file's name."""
    pattern = r"^(.+)-(\d+\.?\d*)-(\d+\.?\d*)\.[a-z0-9]+$"
    return [F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).cast("double").alias("start"), F.regexp_extract(name, pattern, 3).cast("double").alias("duration")]


def gate(center: Column, window: Column, taper: Column) -> tuple[Column, Column]:
    pad = taper + 0.375
    return center - window - pad, center + window + pad


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26: off by at most 1.5e-7."""
    a, t = F.abs(x), 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def power_law(x: Column, alpha: float, lo: float, hi: float) -> Column:
    """Density x**alpha on [lo, hi]; alpha isn't -1."""
    norm = (alpha + 1) / (hi ** (alpha + 1) - lo ** (alpha + 1))
    return F.when(x.between(lo, hi), F.pow(x, F.lit(alpha)) * norm).otherwise(0.0)


def conditional_power_law(x: Column, beta: float, lo: float, hi: Column) -> Column:
    """Density x**beta on [lo, hi] with an upper end per row."""
    norm = (beta + 1) / (F.pow(hi, F.lit(beta + 1)) - lo ** (beta + 1))
    return F.when((x >= lo) & (x <= hi), F.pow(x, F.lit(beta)) * norm).otherwise(0.0)


def log_normal(x: Column, mu: float, sigma: float) -> Column:
    """Density with the given median-log and width."""
    z = (F.log(x) - mu) / sigma
    return F.exp(-0.5 * z * z) / (x * sigma * (2 * 3.141592653589793) ** 0.5)


def truncated_log_normal(x: Column, mu: float, sigma: float, top: Column) -> Column:
    return F.when(x <= top, log_normal(x, mu, sigma) / normal_cdf((F.log(top) - mu) / sigma)).otherwise(0.0)
