"""Draws by tables of distributions, and rounds of draws until a quota is full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import cosmology, priors
from skysift.operators.sampling import uniform


def test_draws_by_a_table(spark):
    values, below = [0.0, 1.0, 3.0, 4.0, 5.0], [0.0, 2.0, 2.0, 3.0, 4.0]
    u = [0.0, 0.25, 0.49999, 0.5, 0.625, 0.75, 0.9999]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(priors.tabulated(values, below)(F.col("u")).alias("x")).collect()
    assert [r.x for r in got] == pytest.approx([0.0, 0.5, 0.99998, 3.0, 3.5, 4.0, 4.9996])
    for bad in ([0.0, 1.0], [1.0, 2.0]), ([0.0, 1.0, 2.0], [0.0, 2.0, 1.0]), ([0.0], [0.0]), ([0.0, 1.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            priors.tabulated(*bad)


def test_redshifts_uniform_in_volume(spark):
    """A share of the draws lies below each redshift as of the volume, summed here step by step."""
    z = np.linspace(0, 0.5, 2001)
    inverse_e = 1 / np.sqrt(cosmology.MATTER * (1 + z) ** 3 + 1 - cosmology.MATTER)
    comoving = np.concatenate(([0], np.cumsum((inverse_e[1:] + inverse_e[:-1]) / 2 * np.diff(z))))
    for dilated in (True, False):
        density = comoving**2 * inverse_e / ((1 + z) if dilated else 1)
        share = np.concatenate(([0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(z))))
        share /= share[-1]
        drawn = spark.range(20_000).select(priors.in_universe(spark, 0.5, dilated=dilated)(uniform(F.col("id"), "z")).alias("z"))
        x = np.sort([r.z for r in drawn.collect()])
        assert x[0] >= 0 and x[-1] <= 0.5
        for q in (0.05, 0.2, 0.35, 0.45):
            assert np.searchsorted(x, q) / 20_000 == pytest.approx(np.interp(q, z, share), abs=0.012)
        exact = spark.createDataFrame([(float(s),) for s in share[[200, 1000, 1800]]], "u double").select(priors.in_universe(spark, 0.5, dilated=dilated)(F.col("u")).alias("z"))
        assert [r.z for r in exact.collect()] == pytest.approx(z[[200, 1000, 1800]], rel=1e-4)
    far = spark.createDataFrame([(0.999999,)], "u double").select(priors.in_universe(spark, 0.5, of="distance")(F.col("u")).alias("d")).first().d
    assert far == pytest.approx((1 + 0.5) * comoving[-1] * cosmology.LIGHT / cosmology.HUBBLE, rel=1e-3)


def test_rounds_until_the_quota(spark):
    asked = []

    def make(ids):
        n = ids.count()
        if n:
            asked.append(n)
        return ids.withColumn("u", uniform(F.col("id"), "u")).withColumn("ok", F.col("u") < 0.1)

    got = priors.until_accepted(spark, 50, make, "ok", most=5000).orderBy("id").collect()
    flags = [r.ok for r in make(spark.range(5000)).orderBy("id").collect()]
    last = [k for k, ok in enumerate(flags) if ok][49]
    assert [r.id for r in got] == list(range(last + 1)) and [r.ok for r in got] == flags[: last + 1]
    assert asked[0] == 50 and 2 <= len(asked) - 1 <= 8  # sizes follow the share accepted so far
    with pytest.raises(ValueError, match="wanted"):
        priors.until_accepted(spark, 50, make, "ok", most=60)
    assert priors.until_accepted(spark, 0, make, "ok", most=60).count() == 0
