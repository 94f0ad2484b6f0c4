"""Batch jobs over a table of sample windows: spectra, whitening, filters, augmentation, scoring.

Array arithmetic stays in SQL's array functions; Fourier transforms run in numpy over Arrow
batches, all windows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .sampling import uniform


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _rows(column: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> list:
    """``f`` over the windows of each length together, in the given order; null windows stay null."""
    out: list = [None] * len(column)
    size = column.map(lambda x: -1 if x is None else len(x))
    for n, part in column.groupby(size):
        if n > 0:
            for i, y in zip(np.flatnonzero(size.to_numpy() == n), f(_stack(part))):
                out[i] = y
        elif n == 0:
            for i in np.flatnonzero(size.to_numpy() == 0):
                out[i] = np.zeros(0)
    return out


def hann(n: int) -> np.ndarray:
    """A periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def rfft(samples: Column) -> Column:
    """Real and imaginary parts of a window's transform."""

    @F.pandas_udf("real array<double>, imag array<double>")
    def f(column: pd.Series) -> pd.DataFrame:
        z = _rows(column, lambda x: np.fft.rfft(x, axis=1))
        return pd.DataFrame({"real": [None if y is None else y.real for y in z], "imag": [None if y is None else y.imag for y in z]})

    return f(samples)


def spectrum(samples: Column, low: int, high: int) -> Column:
    """Magnitudes of the bins from low to high, both included."""
    z = rfft(samples)
    size = F.zip_with(z["real"], z["imag"], lambda a, b: F.sqrt(a * a + b * b))
    return F.slice(size, low + 1, high - low + 1)


def periodogram(length: int, rate: float) -> Callable[[Column], Column]:
    """Power density of a frame: Hann window, doubled but for the ends."""

    @F.pandas_udf("array<double>")
    def f(frames: pd.Series) -> pd.Series:
        w = hann(length)
        double = np.full(length // 2 + 1, 2.0)
        double[0] = double[-1] = 1.0
        return pd.Series(_rows(frames, lambda x: np.abs(np.fft.rfft(x * w, axis=1)) ** 2 * double / (rate * (w * w).sum())))

    return f


def welch(windows: DataFrame, by: str, samples: str, length: int, rate: float, average: str = "median") -> DataFrame:
    """(by, bin, psd): frames of each window, half overlapping, averaged over all frames of a group by bin."""
    from .series import unfold

    frames = windows.select(by, F.explode(unfold(F.col(samples), length, length // 2)).alias("frame"))
    bins = frames.select(by, F.posexplode(periodogram(length, rate)(F.col("frame"))).alias("bin", "power"))
    return bins.groupBy(by, F.col("bin").cast("long").alias("bin")).agg((F.median("power") if average == "median" else F.avg("power")).alias("psd"))


def snr(windows: DataFrame, psd: DataFrame, key: list[str], samples: str, low: int, high: int, df: float, of: Sequence[str] = ()) -> DataFrame:
    """(key, snr): of each window against a density by bin (bounded, broadcast), in a band; ``of`` names the columns of the key that a density is for."""
    z = rfft(F.col(samples))
    power = F.zip_with(z["real"], z["imag"], lambda a, b: a * a + b * b)
    bins = windows.select(*key, F.posexplode(power).alias("bin", "power")).where(F.col("bin").between(low, high))
    got = bins.join(F.broadcast(psd), ["bin", *of]).groupBy(*key).agg(F.sqrt(4 * F.sum(F.col("power") / F.col("psd")) * df).alias("snr"))
    return got


def whiten(windows: DataFrame, samples: str, psd_length: int, frame: int, rate: float, fduration: int, out: str = "white") -> DataFrame:
    """The tail of each window whitened by the density of its head, with a filter of ``fduration`` samples, half of that cropped on both sides."""

    @F.pandas_udf("array<double>")
    def f(column: pd.Series) -> pd.Series:
        w = hann(frame)

        def one(x: np.ndarray) -> np.ndarray:
            head, tail = x[:, :psd_length], x[:, psd_length:]
            n = tail.shape[1]
            starts = range(0, psd_length - frame + 1, frame // 2)
            power = np.stack([np.abs(np.fft.rfft(head[:, s : s + frame] * w, axis=1)) ** 2 for s in starts])
            power = np.median(power, 0) * 2 / (rate * (w * w).sum())
            grid = np.linspace(0, 1, power.shape[1])
            density = np.stack([np.interp(np.linspace(0, 1, n // 2 + 1), grid, p) for p in power])
            # the inverse spectrum as a filter of finite length
            kernel = np.fft.irfft(1 / np.sqrt(np.maximum(density, 1e-30)), n, axis=1)
            shape = np.zeros(n)
            half = fduration // 2
            taper = hann(2 * half)
            shape[:half], shape[n - half :] = taper[half:], taper[:half]
            y = np.fft.irfft(np.fft.rfft(tail, axis=1) * np.fft.rfft(kernel * shape, axis=1), n, axis=1) * np.sqrt(2 / rate)
            return y[:, half : n - half]

        return pd.Series(_rows(column, one))

    return windows.withColumn(out, f(F.col(samples)))


def freq_whiten(windows: DataFrame, samples: str, psd: list[float], low: int, high: int) -> DataFrame:
    """(real, imag) of the windows' transforms, mean removed and Hann windowed, over the root of a density; the band's bins."""

    @F.pandas_udf("real array<double>, imag array<double>")
    def f(column: pd.Series) -> pd.DataFrame:
        def one(x: np.ndarray) -> np.ndarray:
            z = np.fft.rfft((x - x.mean(1, keepdims=True)) * hann(x.shape[1]), axis=1) / np.sqrt(np.asarray(psd))
            return z[:, low : high + 1]

        z = _rows(column, one)
        return pd.DataFrame({"real": [y.real for y in z], "imag": [y.imag for y in z]})

    return windows.withColumn("white", f(F.col(samples)))


def heterodyne(windows: DataFrame, grid: DataFrame, samples: str, rate: float, keep: int) -> DataFrame:
    """Each window against each chirp mass of a bounded grid: the samples, turned back by the chirp's phase, the last ``keep``."""
    both = windows.join(F.broadcast(grid))
    n = F.size(samples)
    # frequency before merger falls with the chirp mass; the phase is its integral up to the window's end
    phase = lambda i: 2 * np.pi * 5.0 / F.col("log_mass") * F.pow((n - i) / rate, F.lit(0.625))
    turned = F.transform(samples, lambda x, i: F.struct((x.cast("double") * F.cos(phase(i))).alias("real"), (-x.cast("double") * F.sin(phase(i))).alias("imag")))
    return both.withColumn("turned", F.slice(turned, F.greatest(n - keep + 1, F.lit(1)), keep))


def lowpass(taps: int, factor: int) -> list[float]:
    """A Hamming-windowed sinc that passes what a rate lower by ``factor`` can hold."""
    k = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(k / factor) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    return (h / h.sum()).tolist()


def resample(blocks: DataFrame, by: str, order: str, samples: str, factor: int, taps: int = 61) -> DataFrame:
    """Every ``factor``-th sample after a symmetric filter; a block borrows its edges from its neighbours, gaps in the order count as zeros."""
    from .strain import beside

    h, half = lowpass(taps, factor), (taps - 1) // 2
    zeros = F.array_repeat(F.lit(0.0), half)
    rows = blocks.withColumn(samples, F.transform(samples, lambda x: x.cast("double")))
    rows = beside(rows, [by], order, samples, half, half)
    rows = rows.withColumns({"_a": F.coalesce("_before", zeros), "_b": F.slice(F.concat(F.coalesce("_after", zeros), zeros), 1, half)})

    @F.pandas_udf("array<double>")
    def f(column: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> np.ndarray:
            n = x.shape[1] - 2 * half
            return np.stack([sum(h[j] * x[:, i + j] for j in range(taps)) for i in range(0, n, factor)], 1)

        return pd.Series(_rows(column, one))

    return rows.withColumn(samples, f(F.concat("_a", samples, "_b"))).select(*blocks.columns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kernels(windows: DataFrame, samples: str, size: int, start: Column, augment: Sequence[Callable[[DataFrame], DataFrame]] = (), out: str = "kernel") -> DataFrame:
    """``windows`` with a kernel of ``size`` samples from ``start`` (0 is the first) on, which each augmentation then makes anew, in order."""
    cut = windows.withColumn(out, F.slice(F.col(samples), start + 1, F.lit(size)))
    for f in augment:
        cut = cut.transform(f)
    return cut


def score_windows(windows: DataFrame, samples: str, scorer: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None, template: list[float] | None = None, out: str = "score") -> DataFrame:
    """The first output of a user's function of batches of windows; by default the dot product with a template."""
    if scorer is None:
        return windows.withColumn(out, dot(F.col(samples), F.array(*(F.lit(float(t)) for t in template))))

    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scorer(batches)

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return windows.withColumn(out, F.pandas_udf(f, "double")(F.col(samples)))


def network_snr(windows: DataFrame, psd: DataFrame, key: Sequence[str], detector: str, samples: str, low: int, high: int, df: float) -> DataFrame:
    """(key, snr): the root of the sum of squares of what all detectors see, each against its own density."""
    each = snr(windows, psd, [*key, detector], samples, low, high, df, of=[detector])
    return each.groupBy(*key).agg(F.sqrt(F.sum(F.col("snr") * F.col("snr"))).alias("snr"))


def target_snrs(snrs: DataFrame, key: str, seed: str, floor: float | None = None, most: float = 1000.0) -> DataFrame:
    """(key, snr, target): every signal gets the SNR of another one, by a permutation from hashes; with ``floor`` no target is below it, or above ``most``."""
    from .ranks import row_ids

    mixed = snrs.withColumn("_mix", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))))
    other = row_ids(mixed.select("_mix", key, F.col("snr").alias("target")), "_mix", (key,), name="_k").select("_k", "target")
    both = row_ids(snrs, key, name="_k").join(other, "_k").drop("_k")
    return both if floor is None else both.withColumn("target", clamped(F.col("target"), floor, most))


def clamped(snr: Column, floor: float, most: float = 1000.0) -> Column:
    return F.greatest(F.least(snr, F.lit(most)), F.lit(floor))


def rescaled(windows: DataFrame, targets: DataFrame, key: Sequence[str], samples: str) -> DataFrame:
    """``windows`` with their samples times target over SNR, the same for all detectors of a key; a signal of no SNR stays as it is."""
    factor = F.when(F.col("snr") > 0, F.col("target") / F.col("snr")).otherwise(1.0)
    return windows.join(targets.select(*key, "snr", "target"), list(key)).withColumn(samples, F.transform(samples, lambda x: x * factor))


def roles(rows: DataFrame, key: str, seed: str, signal: float, swapped: float, muted: float) -> DataFrame:
    """(key, k, role, partner): who takes part in what, in exact numbers, by one rank of hashes.

    The first of an even number are swapped, the k-th of one half with the k-th of the other, the next are muted, then come
    the signals until all three shares together are used up, and the rest is background.
    """
    from .ranks import row_ids

    ranked = row_ids(rows.select(key).distinct().withColumn("_mix", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))), "_mix", (key,), name="k").drop("_mix")
    n = rows.select(key).distinct().count()
    half, quiet, chosen = int(n * swapped / 2), int(n * muted), int(n * (signal + swapped + muted))
    k = F.col("k")
    role = F.when(k < 2 * half, "swapped").when(k < 2 * half + quiet, "muted").when(k < chosen, "signal").otherwise("background")
    with_role = ranked.withColumn("role", role)
    place = F.when(k < half, k + half).when(k < 2 * half, k - half)
    partner = ranked.select(k.alias("_at"), F.col(key).alias("partner"))
    return with_role.withColumn("_at", place).join(partner, "_at", "left").select(key, "k", "role", "partner")


def paired(scored: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], score: str) -> DataFrame:
    """(by, a column per kind): the scores of one place side by side; null where a kind has none."""
    return scored.groupBy(*by).agg(*(F.first(F.when(F.col(kind) == k, F.col(score)), ignorenulls=True).alias(k) for k in kinds))


def flip(samples: Column, *key: Column | str, p: float = 0.5) -> Column:
    """Inverted and reversed in time, each with its own chance."""
    a = F.when(uniform(*key, "sign") < p, F.transform(samples, lambda x: -x)).otherwise(samples)
    return F.when(uniform(*key, "time") < p, F.reverse(a)).otherwise(a)


def project(plus: Column, cross: Column, f_plus: Column, f_cross: Column, delay: Column) -> Column:
    """A detector's response, delayed by whole samples with zeros in front."""
    h = F.zip_with(plus, cross, lambda a, b: f_plus * a.cast("double") + f_cross * b.cast("double"))
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), delay), h), F.lit(1), F.size(plus))


def slice_pad(samples: Column, at: Column, left: int, right: int) -> Column:
    """``left`` samples before and ``right`` from the signal's index on, zeros where the window has none."""
    x = F.transform(samples, lambda v: v.cast("double"))
    padded = F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), right))
    return F.slice(padded, at + 1, F.lit(left + right))


def align(samples: Column, size: int, coalescence: Column, right_pad: int) -> Column:
    """A waveform rolled so that its coalescence is ``right_pad`` from the end, padded on the left when short, cropped when long."""
    x = F.transform(samples, lambda v: v.cast("double"))
    n = F.size(samples)
    long = F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - n, F.lit(0))), x)
    m = F.size(long)
    at = coalescence + m - n
    roll = F.pmod(at - (m - right_pad), m).cast("int")
    rolled = F.concat(F.slice(long, roll + 1, m - roll), F.slice(long, F.lit(1), roll))
    return F.slice(rolled, m - size + 1, F.lit(size))
