"""Poisson intervals, intervals in spans, roles and targets of a training set."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.functions import poisson
from skysift.operators import intervals, sensitivity, signal


def upto(k, mean):
    """The share of a Poisson distribution up to k, term by term, exactly but for the last exponential."""
    m, term, total = Fraction(mean), Fraction(1), Fraction(1)
    for j in range(1, k + 1):
        term = term * m / j
        total += term
    return float(total) * math.exp(-mean) if mean < 600 else math.exp(math.log(total.numerator) - math.log(total.denominator) - mean)


def test_incomplete_gamma():
    for mean in (0.001, 0.5, 1.0, 7.25, 60.0, 650.0):
        for k in {0, 1, 3, int(mean), int(mean + 3 * math.sqrt(mean)), max(0, int(mean - 3 * math.sqrt(mean)))}:
            assert poisson.gamma_upper(k + 1.0, mean) == pytest.approx(upto(k, mean), rel=1e-10)
    assert poisson.gamma_upper(3.0, 0.0) == 1
    # by the error function, and far out
    x = np.array([0.01, 0.3, 2.0, 9.0])
    assert np.allclose(poisson.gamma_upper(0.5, x), [math.erfc(math.sqrt(v)) for v in x], rtol=1e-10)
    assert poisson.gamma_upper(1e6 + 1, 1e6) == pytest.approx(0.5, abs=1e-3)


def test_quantiles_are_the_least():
    means = np.array([0.001, 0.2, 1.0, 2.5, 7.0, 31.4, 200.0, 5000.0, 2e6])
    for share in (0.00135, 0.158, 0.5, 0.841, 0.99865):
        k = poisson.quantile(share, means)
        assert (poisson.gamma_upper(k + 1, means) >= share).all()
        below = k > 0
        assert (poisson.gamma_upper(k[below], means[below]) < share).all()
    # fixed values: counts with a mean of 5 lie within 1, 2 and 3 sigma from 3 to 7, 1 to 10 and 0 to 13
    assert [(poisson.quantile((1 - s) / 2, np.array([5.0]))[0], poisson.quantile((1 + s) / 2, np.array([5.0]))[0]) for s in (0.682689, 0.954499, 0.9973)] == [(3, 7), (1, 10), (0, 13)]


def test_bands(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.001), (3, None), (4, 5.0), (5, -1.0)], "id long, mean double")
    low, high = sensitivity.count_band(F.col("mean"), 0.682689)
    got = {r.id: (r.low, r.high) for r in df.select("id", low.alias("low"), high.alias("high")).collect()}
    assert got[1] == got[4] == (2.5, 7.5) and got[2] == (0.0, 0.5) and got[3][1] is None and got[5][1] is None


def test_spans_split_what_crosses_them(spark):
    seg = [("a", 0.0, 100.0), ("b", 10.0, 60.0), ("b", 55.0, 120.0)]
    df = spark.createDataFrame(seg, "flag string, start double, stop double")
    cut = lambda **k: sorted((r.start, r.stop) for r in intervals.intersect(df, "flag", ["a", "b"], **k).collect())
    assert cut() == [(10.0, 100.0)]
    assert cut(spans=[(0.0, 40.0), (45.0, 200.0)]) == [(10.0, 40.0), (45.0, 100.0)]
    assert cut(spans=[(0.0, 12.0), (45.0, 200.0)], least=5.0) == [(45.0, 100.0)]
    assert cut(spans=[(0.0, 40.0), (40.0, 200.0)]) == [(10.0, 100.0)] and cut(spans=[(300.0, 400.0)]) == []


def test_roles_in_exact_numbers(spark):
    rows = spark.range(1000).selectExpr("id div 2 as block")
    got = signal.roles(rows, "block", "role", 0.3, 0.11, 0.1).collect()
    assert Counter(r.role for r in got) == {"swapped": 54, "muted": 50, "signal": 255 - 104, "background": 245}
    partner = {r.block: r.partner for r in got}
    swapped = [r.block for r in got if r.role == "swapped"]
    assert all(partner[partner[b]] == b != partner[b] for b in swapped) and all(r.partner is None for r in got if r.role != "swapped")
    assert [r.block for r in got] and sorted(signal.roles(rows, "block", "role", 0.3, 0.11, 0.1).collect()) == sorted(got)


def test_rescaled_to_targets(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 2, 32)) * rng.uniform(0.2, 5, (40, 1, 1))
    df = spark.createDataFrame([(b, d, x[b, k].tolist()) for b in range(40) for k, d in enumerate(("H1", "L1"))], "block long, ifo string, samples array<double>")
    psd = spark.createDataFrame([(k, d, 1.0 + k * (1 if d == "H1" else 2)) for k in range(17) for d in ("H1", "L1")], "bin int, ifo string, psd double")
    snrs = signal.network_snr(df, psd, ["block"], "ifo", "samples", 2, 14, 0.25)
    want = [math.sqrt(sum(4 * 0.25 * abs(z) ** 2 / (1.0 + f * (1 + k)) for k in (0, 1) for f, z in enumerate(np.fft.rfft(x[b, k])) if 2 <= f <= 14)) for b in range(40)]
    assert {r.block: r.snr for r in snrs.collect()} == pytest.approx(dict(enumerate(want)))
    for floor in (None, 6.0):
        targets = signal.target_snrs(snrs, "block", "s", floor)
        got = {r.block: r.target for r in targets.collect()}
        assert sorted(got.values()) == pytest.approx(sorted(w if floor is None else min(max(w, floor), 1000) for w in want))
        assert sum(abs(got[b] - want[b]) > 1e-9 for b in got) > 20
        after = signal.network_snr(signal.rescaled(df, targets, ["block"], "samples"), psd, ["block"], "ifo", "samples", 2, 14, 0.25)
        assert {r.block: r.snr for r in after.collect()} == pytest.approx(got)
