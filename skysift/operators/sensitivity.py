"""False-alarm rates, significance, sensitive volumes and densities of statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import poisson
from ..functions.columns import YEAR_FAR
from .matching import interpolate
from .ranks import running


def far(nb: Column, tb: Column) -> Column:
    """False alarms per year, at least what one event would make."""
    return F.greatest(YEAR_FAR * nb / tb, YEAR_FAR / tb)


def significance(nb: Column, tb: Column, span: float) -> Column:
    """The chance of a background event at least as loud within a span."""
    return 1 - F.exp(-span * (1 + nb) / tb)


def shifts_for_livetime(segments: DataFrame, tb: float, shift: float, psd_length: float) -> DataFrame:
    """The least number of shifts whose background reaches ``tb``; null where all that leave any segment something don't.

    A segment gives shift k what it is longer than k shifts; those it outlasts are counted segment by segment, so the background up to
    each such count is a sum in closed form, and only the shifts between the two counts that enclose ``tb`` are listed.
    """
    if tb <= 0:
        return segments.sparkSession.range(1).select(F.lit(0).cast("long").alias("shifts"))
    rows = segments.select((F.col("stop") - F.col("start") - psd_length).alias("room")).where(f"room >= {shift!r}D")
    # a row per number of shifts: at most the longest segment over the shift
    most = rows.groupBy(F.floor(F.col("room") / shift).cast("long").alias("k1")).agg(F.count(F.lit(1)).alias("n"), F.sum("room").alias("s"))
    down = Window.orderBy(F.desc("k1"))
    most = most.select("k1", F.lead("k1", 1, 0).over(down).alias("k0"), F.sum("n").over(down).alias("n"), F.sum("s").over(down).alias("s"))
    upto = lambda k: (k - F.col("k0")) * F.col("s") - shift * F.col("n") * (k * (k + 1) - F.col("k0") * (F.col("k0") + 1)) / 2
    most = most.withColumn("gain", upto(F.col("k1"))).withColumn("total", F.sum("gain").over(Window.orderBy("k1")))
    here = most.where(F.col("total") >= tb).agg(F.min(F.struct("k1", "k0", "n", "s", (F.col("total") - F.col("gain")).alias("before"))).alias("m")).select("m.*")
    listed = here.where("k1 is not null").withColumn("k", F.explode(F.sequence(F.col("k0") + 1, F.col("k1"))))
    return listed.where((F.col("k") == F.col("k1")) | (F.col("before") + upto(F.col("k")) >= tb)).agg(F.min("k").alias("shifts"))


def shifts_for_signals(segments: DataFrame, spacing: float, shift: float, buffer: float, duration: float, n: int) -> DataFrame:
    """The number of shifts that makes room for n signals: the smaller root, rounded up."""
    buffer, spacing = buffer + duration // 2, spacing + duration
    rows = segments.agg(F.sum(F.col("stop") - F.col("start")).alias("t"))
    a, b = -shift / 2, F.col("t") - 2 * buffer - shift / 2
    root = (-b + F.sqrt(b * b - 4 * a * (-n * spacing))) / (2 * a)
    return rows.select(F.ceil(root).cast("long").alias("shifts"))


def importance(df: DataFrame, weight: str) -> DataFrame:
    """Weights divided by their sum over all rows."""
    total = df.agg(F.sum(weight).alias("_total"))
    return df.join(F.broadcast(total)).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def volume(df: DataFrame, thresholds: DataFrame, stat: str, weights: dict[str, str], v0: float) -> DataFrame:
    """(name, threshold, volume, sigma): sensitive volume and its error of each weighting at each threshold, in one pass of running sums."""
    ask = thresholds.select(F.col("threshold").alias("_x"), *(F.lit(0.0).alias(f"w{i}") for i in range(len(weights))), F.lit(True).alias("asked"))
    rows = df.select(F.col(stat).alias("_x"), *(F.col(w).alias(f"w{i}") for i, w in enumerate(weights.values())), F.lit(False).alias("asked"))
    sums = {f"mu{i}": f"w{i}" for i in range(len(weights))} | {f"s{i}": f"w{i} * w{i}" for i in range(len(weights))}
    out = running(ask.unionByName(rows), "_x", sums, ties=True).where("asked")
    out = out.join(F.broadcast(df.agg(*(F.sum(F.col(w) * F.col(w)).alias(f"all{i}") for i, w in enumerate(weights.values())))))
    each = []
    for i, name in enumerate(weights):
        mu = F.col(f"mu{i}")
        variance = (1 - 2 * mu) * F.col(f"s{i}") + mu * mu * F.col(f"all{i}")
        each.append(F.struct(F.lit(name).alias("name"), (mu * v0).alias("volume"), (F.sqrt(F.greatest(variance, F.lit(0.0))) * v0).alias("sigma")))
    return out.select(F.col("_x").alias("threshold"), F.inline(F.array(*each))).select("name", "threshold", "volume", "sigma")


def threshold_grid(df: DataFrame, stat: str, max_far: float, tb: float) -> DataFrame:
    """(threshold, k, far) of the loudest events up to a rate; nothing where that rate allows none."""
    n = int(max_far * tb)
    top = df.select(F.col(stat).alias("threshold")).orderBy(F.desc("threshold")).limit(n)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("threshold"))).cast("long")).withColumn("far", F.col("k") / tb)


def log_vt(df: DataFrame, thresholds: DataFrame, stat: str, log_weight: str, span: float, drawn: int) -> DataFrame:
    """log VT, the logarithm of its error and the effective number of events at each threshold, by sums of exponentials shifted by the largest."""
    top = df.agg(F.max(log_weight).alias("m"))
    e = F.exp(F.col(log_weight) - F.col("m"))
    rows = df.join(F.broadcast(top)).select(F.col(stat).alias("_x"), e.alias("e"), (e * e).alias("e2"), F.lit(False).alias("asked"))
    rows = rows.unionByName(thresholds.select(F.col("threshold").alias("_x"), F.lit(0.0).alias("e"), F.lit(0.0).alias("e2"), F.lit(True).alias("asked")))
    out = running(rows, "_x", {"s1": "e", "s2": "e2"}, ties=True).where("asked and s1 > 0").join(F.broadcast(top))
    scale, rest = math.log(span) - math.log(drawn) + F.col("m"), F.col("s2") - F.col("s1") * F.col("s1") / drawn
    return out.select(
        F.col("_x").alias("threshold"), (scale + F.log("s1")).alias("log_vt"), (scale + F.log(rest) / 2).alias("log_sigma"), (F.col("s1") * F.col("s1") / rest).alias("n_eff")
    )


def log_spin_density(spin: Column, largest: Column) -> Column:
    """An isotropic spin's log density, uniform in its size up to the largest."""
    return F.when(spin < largest, -math.log(4 * math.pi) - F.log(largest) - F.log(spin * spin))


def trapezoid(grid: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the area under a grid's points (a bounded table)."""
    w = Window.orderBy(x)
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) + F.col(y)
    return grid.select((dx * dy / 2).alias("a")).agg(F.sum("a").alias("area"))


def solid_angle(low: Column, high: Column) -> Column:
    """Of a band of declinations."""
    return 2 * math.pi * (F.sin(high) - F.sin(low))


def kde(df: DataFrame, stat: str, grid: DataFrame, at: str) -> DataFrame:
    """(at, pdf): Gaussian kernel density at a grid's points, with Scott's bandwidth; the grid is bounded and broadcast as one array."""
    x = df.select(F.col(stat).cast("double").alias("_x"))
    shape = x.agg((F.stddev_samp("_x") * F.pow(F.count("_x"), F.lit(-0.2))).alias("_h"), F.count("_x").alias("_n"))
    points = x.join(F.broadcast(shape)).join(F.broadcast(grid.agg(F.collect_list(at).alias("_g"))))
    each = points.select("_h", "_n", "_x", F.explode("_g").alias(at)).withColumn("_e", F.exp(-F.pow((F.col(at) - F.col("_x")) / F.col("_h"), F.lit(2)) / 2))
    return each.groupBy(at, "_h", "_n").agg(F.sum("_e").alias("_s")).select(at, (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("pdf"))


def kde_with_tail(density: DataFrame, at: str, threshold: float) -> DataFrame:
    """(at, pdf): beyond where the density falls below the threshold, a line fitted to its logarithm between ten times and once that."""
    peak = density.agg(F.max_by(at, "pdf").alias("peak"))
    d = density.join(F.broadcast(peak))
    after = F.col(at) > F.col("peak")
    ends = d.agg(F.min(F.when(after & (F.col("pdf") <= 10 * threshold), F.col(at))).alias("start"), F.min(F.when(after & (F.col("pdf") <= threshold), F.col(at))).alias("stop"))
    d = density.join(F.broadcast(ends))
    line = d.where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).agg(F.regr_slope(F.log("pdf"), F.col(at)).alias("slope"), F.regr_intercept(F.log("pdf"), F.col(at)).alias("intercept"))
    return d.join(F.broadcast(line)).select(at, F.when(F.col(at) >= F.col("stop"), F.exp(F.col("intercept") + F.col("slope") * F.col(at))).otherwise(F.col("pdf")).alias("pdf"))


class Density:
    """A density of a statistic: ``fit`` gives its parameters as a table of points, ``apply`` the density at the values of a column.

    With a ``tail`` the density goes on as an exponential from where it falls below ``tail`` over the square root of the number of rows.
    """

    def __init__(self, stat: str, grid: DataFrame, at: str = "pt", tail: float | None = None):
        self.stat, self.grid, self.at, self.tail = stat, grid, at, tail

    def fit(self, df: DataFrame) -> DataFrame:
        points = kde(df, self.stat, self.grid, self.at)
        return points if self.tail is None else kde_with_tail(points, self.at, self.tail / df.where(F.col(self.stat).isNotNull()).count() ** 0.5)

    def apply(self, df: DataFrame, params: DataFrame, out: str = "pdf") -> DataFrame:
        return interpolate(df, self.stat, params, self.at, "pdf", out)


def p_astro(foreground: Column, background: Column) -> Column:
    return foreground / (foreground + background)


def class_probs(events: DataFrame, posterior: DataFrame, key: str, mass: str, low: float, high: float) -> DataFrame:
    """The probability of each class by the shares of low and high masses; without a posterior all of it is the heaviest class."""
    share = posterior.groupBy(key).agg(F.avg((F.col(mass) < low).cast("double")).alias("_low"), F.avg((F.col(mass) > high).cast("double")).alias("_high"))
    e = events.join(share, key, "left")
    bns, bbh = F.col("p") * F.coalesce("_low", F.lit(0.0)), F.col("p") * F.coalesce("_high", F.lit(1.0))
    return e.withColumns({"bns": bns, "bbh": bbh, "nsbh": F.col("p") - bns - bbh, "terrestrial": 1 - F.col("p")}).drop("_low", "_high")


def survival(df: DataFrame, stat: str, bins: int) -> DataFrame:
    """(bin, survivors, centre): events at or above each of equal bins; the last one takes in the maximum."""
    ends = F.broadcast(df.agg(F.min(stat).alias("lo"), F.max(stat).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    n = df.where(F.col(stat).isNotNull()).join(ends).groupBy(F.least(F.floor((F.col(stat) - F.col("lo")) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(n), "bin", "left").join(ends)
    return all_bins.select("bin", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.desc("bin"))).alias("survivors"), (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"))


def rate(df: DataFrame, time: str, seconds: int, back: int | None = None) -> DataFrame:
    """(hour, n): events per span of seconds from the first event's whole hour on, empty spans included; with ``back`` only spans that begin so many seconds before the last event, or later."""
    first = F.broadcast(df.agg(F.min(F.unix_timestamp(F.date_trunc("hour", time))).alias("a"), F.max(F.unix_timestamp(time)).alias("b")))
    n = df.join(first).groupBy(F.expr(f"(unix_timestamp({time}) - a) div {seconds}").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spans = first.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(b - a) div {seconds}"))).alias("k"))
    if back is not None:
        spans = spans.where(F.col("a") + F.col("k") * seconds >= F.col("b") - back)
    return spans.join(n, "k", "left").select((F.col("a") + F.col("k") * seconds).alias("hour"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def log_bins(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """(by, bin, n, median, p90): counts in bins of equal ratio from the least to the largest value above 0, empty ones included; null values are dropped."""
    rows = df.where(F.col(value) > 0)
    facts = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor(F.log(F.col(value) / F.col("_lo")) / F.log(F.col("_hi") / F.col("_lo")) * bins)).otherwise(0)
    n = rows.join(facts, by).groupBy(by, F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = facts.select(by, "median", "p90", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(n, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "median", "p90")


def count_band(mean: Column, share: float) -> tuple[Column, Column]:
    """Where a count of this mean lies with a probability of ``share``, half a count wider and not below 0."""
    band = poisson.interval(mean, share)
    return F.greatest(band["low"] - 0.5, F.lit(0.0)), band["high"] + 0.5


def scale_factor(recovered: int | Column, generated: int | Column, volume: Column, density: float) -> Column:
    """Signals per year to find: events per year and volume, times the volume of the injections, times the share of them that is recovered."""
    return density * volume * recovered / generated
