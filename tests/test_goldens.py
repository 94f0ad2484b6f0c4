"""Small exact cases of the operators."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.functions import columns as c
from skysift.functions import detectors
from skysift.operators import cosmology, intervals, matching, priors, ranks, sampling, sensitivity, series, signal
from skysift.sources import ledger
from skysift.streaming import live

YEAR = c.YEAR_FAR


def ten(spark):
    return spark.range(10).select(F.col("id").cast("double").alias("detection_statistic"), F.col("id").cast("double").alias("detection_time"))


def test_counts_and_rates(spark):
    t = spark.createDataFrame([(5.0,), (5.5,), (-1.0,)], "threshold double")
    got = {r.threshold: r for r in ranks.counts_at_least(ten(spark), t).withColumn("far", sensitivity.far(F.col("nb"), F.lit(2 * YEAR))).collect()}
    assert (got[5.0].nb, got[5.5].nb, got[-1.0].nb) == (5, 4, 10)
    assert got[5.0].far == pytest.approx(2.5) and got[5.5].far == pytest.approx(2.0)


def test_ranks_with_ties(spark):
    values = np.random.default_rng(0).integers(0, 40, 3000).tolist()
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(values)], "x double, i long").repartition(5)
    out = ranks.running(df, "x", {"n": "1L"}, ties=True).collect()
    assert all(r.n == sum(v >= r.x for v in values) for r in out[:200]) and len(out) == 3000
    assert sorted(r.row_id for r in ranks.row_ids(df, "x", ("i",)).collect()) == list(range(3000))
    assert ranks.kth_largest(df, "x", 7).first()[0] == sorted(values)[-7]
    assert ranks.kth_largest(df, "x", 0).first()[0] is None and ranks.kth_largest(df, "x", 0, compat=True).first()[0] == 0


def test_no_hot_range(spark, monkeypatch):
    """One value in 90 % of the rows, and many nulls: ranges stay even, with ties counted together and without."""
    sizes = []
    fixed = ranks.fixed
    monkeypatch.setattr(ranks, "fixed", lambda df, name: (out := fixed(df, name), sizes.append([r.n for r in out.groupBy("_range").agg(F.count("*").alias("n")).collect()]))[0])
    x = F.when(F.col("id") % 10 < 9, 7.0).when(F.col("id") % 20 == 9, F.lit(None)).otherwise(F.col("id").cast("double"))
    df = spark.range(40_000).select(x.alias("x"), F.col("id").alias("i")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.running(df, "x", {"n": "1L"}, ties=True)
        assert {r.n: r.k for r in got.where("x = 7.0 or x is null").groupBy("x", "n").agg(F.count("*").alias("k")).collect()} == {38_000: 36_000, 40_000: 2_000}
        assert ranks.row_ids(df, "x", ("i",)).select("row_id").distinct().count() == 40_000
        assert ranks.kth_largest(df, "x", 2_001).first()[0] == 7.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(max(n) <= 2 * sum(n) / len(n) + 1 for n in sizes) and max(map(len, sizes)) > 1


def test_values_before(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, float(t), None if rng.random() < 0.4 else int(rng.integers(9))) for k, t in enumerate(rng.integers(0, 300, 400))] + [(999, 0, None, 5)]
    df = spark.createDataFrame(rows, "id long, g long, t double, v long")
    got = {r.id: r.before for r in matching.earlier(df, ["g"], "t", {"before": F.col("v")}, 20.0, ("id",)).collect()}
    for k, g, t, _ in rows:
        past = sorted((s, i, v) for i, h, s, v in rows if t is not None and s is not None and h == g and (s, i) < (t, k) and v is not None)
        assert got[k] == (past[-1][2] if past else None)


def test_boxcar_over_ranges(spark):
    y = np.random.default_rng(2).random(1000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y) if i % 17], "s string, i long, y double")
    y[::17] = 0
    for width, length in ((1, 64), (7, 64), (100, 64), (7, 1 << 16)):
        want = np.convolve(y, np.ones(width))[:1000] / width
        assert all(r.y == pytest.approx(want[r.i]) for r in series.boxcar(df, width, ["s"], length=length).collect())


def test_shifts(spark):
    seg = lambda *xs: spark.createDataFrame([(float(a), float(b)) for a, b in xs], "start double, stop double")
    tb = lambda s, t: sensitivity.shifts_for_livetime(s, t, 1.0, 64.0).first()[0]
    assert tb(seg((0, 1000)), 0) == 0 and tb(seg((0, 1000)), 1) == 1 and tb(seg((0, 200)), 1000) == 8 and tb(seg((0, 600), (1000, 1600)), 2000) == 2
    assert tb(seg((0, 65)), 1e9) is None
    rng = np.random.default_rng(4)
    many = [(0.0, float(n)) for n in rng.integers(10, 3000, 60)] + [(0.0, 3000.0)]
    for want in (1, 7, 40, 500, 2936):
        total = lambda k: sum(max(b - 64 - j, 0) for _, b in many for j in range(1, k + 1))
        assert tb(seg(*many), total(want)) == (want if want < 2936 else 2935)  # the last shift leaves nothing
        assert tb(seg(*many), total(want) - 0.5) <= want
    assert tb(seg(*many), total(2936) + 1) is None
    sig = lambda s, n: sensitivity.shifts_for_signals(s, 16.0, 1.0, 8.0, 8.0, n).first()[0]
    assert sig(seg((0, 10000)), 0) == 0 and sig(seg((0, 10000)), 1) == 1 and sig(seg((0, 5000), (10000, 15000)), 1000) == 3


def test_analyzable_and_small_functions(spark):
    rows = spark.createDataFrame([(0.0, 1000.0, 100.0), (0.0, 100.0, 100.0), (0.0, 100.0, 99.0)], "a double, b double, psd double")
    ok = (F.col("b") - F.col("a")) - F.array_max(F.array(F.lit(0.0), F.lit(1.0))) - F.col("psd") > 0
    assert [r[0] for r in rows.select(ok).collect()] == [True, False, False]
    assert spark.range(1).select(c.analyzable(F.lit(0.0), F.lit(1000.0), F.array(F.lit(0.0), F.lit(1.0)), 100.0)).first()[0]
    for (x, y), want in {(9, 3): 3, (10, 3): 4, (1, 10): 1, (0, 1): 0}.items():
        assert spark.range(1).select(c.ceil_div(F.lit(x), F.lit(y))).first()[0] == want
    assert series.clock(0, 10, 1, 0.5) == 9.0
    x = spark.createDataFrame([(v,) for v in np.linspace(-3, 3, 25).tolist()], "x double").select("x", c.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 2e-7 for r in x)


def test_shift_filter_and_reads(spark):
    rows = [(float(i), [0.0, float(s)], float(i)) for i, s in enumerate([0] * 5 + [1, 1, 2, 2, 2])]
    df = spark.createDataFrame(rows, "detection_statistic double, shift array<double>, injection_time double")
    assert [r[0] for r in df.where(F.col("shift") == F.array(F.lit(0.0), F.lit(1.0))).collect()] == [5.0, 6.0]
    times = lambda *a: [r.injection_time for r in ledger.near(df, *a, 2.0).collect()]
    assert times(2.5, None) == list(range(1, 10)) and times(None, 6) == list(range(9)) and times(3.5, 5) == list(range(2, 8))
    with pytest.raises(ValueError):
        ledger.near(df, 0, 1, 1.0, [[0], [0, 1]])


def test_vetoes(spark):
    ev = spark.createDataFrame([(i, float(i), [0.0, float(s)]) for i, s in enumerate([1, 1, 2, 2, 3])], "row long, detection_time double, shift array<double>")
    vetoes = spark.createDataFrame([(0.5, 1.5), (3.5, 4.5)], "start double, stop double")
    kept = lambda k: sorted(r.row for r in intervals.veto(ev, vetoes, F.col("shift")[k], "row", 1.0).collect())
    assert kept(0) == [0, 2, 3] and kept(1) == [1, 3, 4]


def test_recover(spark):
    ev = spark.createDataFrame([(s, i, float(i), float(i + 5)) for s in (0, 1) for i in range(10)], "slide long, event_id long, detection_time double, detection_statistic double")
    inj = spark.createDataFrame([(s, t) for s in (0, 1, 2) for t in (1.4, 8.6, 3.1)], "slide long, injection_time double")
    got = matching.nearest(inj, ev, ["slide"], "injection_time", "detection_time", "event_id").collect()
    assert sorted((r.slide, r.injection_time, r.detection_statistic) for r in got) == [(s, t, x) for s in (0, 1) for t, x in ((1.4, 6.0), (3.1, 8.0), (8.6, 14.0))]


def test_nearest_breaks_ties_early(spark):
    ev = spark.createDataFrame([(0, 5, 1.0), (0, 3, 1.0), (0, 4, 3.0)], "slide long, event_id long, detection_time double")
    inj = spark.createDataFrame([(0, 2.0)], "slide long, injection_time double")
    assert matching.nearest(inj, ev, ["slide"], "injection_time", "detection_time", "event_id").first().event_id == 3


def test_segment_names(spark):
    names = spark.createDataFrame([("background-1234567890-1000.hdf",), ("background-1000000000.5-50.25.hdf",), ("junk",)], "name string")
    got = ledger.names_to_segments(names, "name").collect()
    assert [(r.start, r.stop) for r in got if r.ok] == [(1234567890.0, 1234568890.0), (1000000000.5, 1000000050.75)] and not got[2].ok


def test_solid_angle_and_trapezoid(spark):
    full, half, none = spark.range(1).select(*(sensitivity.solid_angle(F.lit(a), F.lit(b)) for a, b in ((-math.pi / 2, math.pi / 2), (0.0, math.pi / 2), (0.3, 0.3)))).first()
    assert full / half == pytest.approx(2) and none == 0


def test_merged_metadata(spark):
    rows = spark.createDataFrame([(1, 100.0, 16), (1, 50.0, 16), (2, 100.0, 8)], "d long, tb double, rate long")
    assert {r.d: (r.tb, r.rate) for r in ledger.merge_metadata(rows, "d", ["tb"], ["rate"]).collect()} == {1: (150.0, 16), 2: (100.0, 8)}
    with pytest.raises(Exception, match="rate differs"):
        ledger.merge_metadata(rows.withColumn("d", F.lit(1)), "d", ["tb"], ["rate"]).collect()
    with pytest.raises(ValueError):
        ledger.read(spark, "/root/testdata/sf0.001/region.parquet", ["nothing"])


def brute_peaks(y, half):
    """Repeatedly: the first largest of what lies ahead, if it is larger; else a peak."""
    i, out = max(range(min(half, len(y))), key=lambda k: (y[k], -k)), []
    while i < len(y):
        ahead = range(i + 1, min(len(y), i + 1 + half))
        best = max(ahead, key=lambda k: (y[k], -k), default=None)
        if best is not None and y[best] > y[i]:
            i = best
        else:
            out.append(i)
            i += half + 1
    return out


def test_peaks_and_boxcar(spark):
    r = np.random.default_rng(3)
    y = {s: r.integers(0, 9, 200).astype(float) for s in range(3)}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in y.items() for i, v in enumerate(x)], "slide long, i long, y double").repartition(4)
    got = series.cluster_peaks(df, 10, ["slide"]).collect()
    assert sorted((g.slide, g.i) for g in got) == sorted((s, i) for s, x in y.items() for i in brute_peaks(x.tolist(), 5))
    box = {(g.slide, g.i): g.y for g in series.boxcar(df, 7, ["slide"]).collect()}
    for s, x in y.items():
        assert np.allclose([box[s, i] for i in range(200)], np.convolve(x, np.ones(7) / 7)[:200])


def test_peaks_do_not_depend_on_ranges(spark):
    r = np.random.default_rng(8)
    rows = [(s, i, float(r.integers(0, 30))) for s in range(3) for i in range(40 * s, 400 + s) if r.random() > 0.03 and not (s == 2 and 150 < i < 290)]
    df = spark.createDataFrame(rows, "slide long, i long, y double").repartition(4)
    want = None
    for length in (16, 37, 1 << 16):
        got = sorted((g.slide, g.i, g.y) for g in series.cluster_peaks(df, 10, ["slide"], length=length).collect())
        want = want or got
        assert got == want
    # missing samples count as lower than all others
    for s in range(3):
        y = {i: v for k, i, v in rows if k == s}
        line = [y.get(i, -1.0) for i in range(min(y), max(y) + 1)]
        assert [i for k, i, _ in want if k == s] == [i + min(y) for i in brute_peaks(line, 5) if i + min(y) in y]


def test_refractory_by_ranges(spark):
    r = np.random.default_rng(9)
    rows = [(s, float(t)) for s in range(3) for t in np.sort(r.choice([r.uniform(0, 500, 300), np.arange(300) * 1.5][s % 2], 200))]
    want = []
    for s in range(3):
        last = -np.inf
        for t in sorted(t for k, t in rows if k == s):
            if t - last >= 5:
                want.append((s, t))
                last = t
    df = spark.createDataFrame(rows, "slide long, t double").repartition(4)
    for length in (10.0, 33.0, None):
        assert sorted(tuple(g) for g in series.refractory(df, ["slide"], "t", 5.0, length).collect()) == want


def test_beside_across_ranges(spark):
    r = np.random.default_rng(10)
    left = [(int(k), float(t)) for k, t in zip(r.integers(0, 2, 60), r.uniform(0, 1000, 60))]
    right = [(int(k), i, float(t)) for i, (k, t) in enumerate(zip(r.integers(0, 2, 25), r.uniform(0, 1000, 25)))]
    a, b = spark.createDataFrame(left, "slide long, injection_time double"), spark.createDataFrame(right, "slide long, event_id long, detection_time double")
    want = sorted((k, t, min((abs(u - t), u, i) for j, i, u in right if j == k)[2]) for k, t in left)
    for width in (7.0, 100.0, 1e6):
        got = matching.nearest(a, b, ["slide"], "injection_time", "detection_time", "event_id", width).collect()
        assert sorted((g.slide, g.injection_time, g.event_id) for g in got) == want
    grid = spark.createDataFrame([(float(x), float(x * x)) for x in range(0, 100, 3)], "x double, y double")
    q = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 1.0, 50.2, 99.0, 120.0, None)], "q double")
    for width in (2.0, 64.0):
        got = {g.q: g.out for g in matching.interpolate(q, "q", grid, "x", "y", "out", width).collect()}
        assert got.pop(None) is None
        assert all(v == pytest.approx(np.interp(k, np.arange(0, 100, 3), np.arange(0, 100, 3.0) ** 2)) for k, v in got.items())


def test_merged_intervals(spark):
    r = np.random.default_rng(11)
    rows = [(int(g), float(s), float(s + w)) for g, s, w in zip(r.integers(0, 2, 200), r.integers(0, 900, 200), r.integers(0, 9, 200))]
    got = sorted(tuple(x) for x in intervals.merge(spark.createDataFrame(rows, "g long, start double, stop double"), ["g"]).collect())
    want = []
    for g, s, e in sorted(x for x in rows if x[1] < x[2]):
        if want and want[-1][0] == g and s <= want[-1][2]:
            want[-1] = (g, want[-1][1], max(want[-1][2], e))
        else:
            want.append((g, s, e))
    assert got == want


def test_silence_is_told_without_a_later_block(spark, tmp_path):
    import time

    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(seconds=10 * k)
    batches = [[(0, k, at(k), 1.0, True) for k in range(3)] + [(1, 0, at(0), 1.0, True)], [(0, k, at(k), 1.0, True) for k in range(3, 30)], [(0, 30, at(30), 1.0, True)], [(1, 30, at(30), 1.0, True)]]
    for rows in batches:
        spark.createDataFrame(rows, "ifo long, i long, ts timestamp, y double, ready boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = live.follow(spark, str(tmp_path / "in"), "ifo long, i long, ts timestamp, y double, ready boolean", 1)
    got = live.drain(live.Gaps("60 seconds").apply(stream)).select("ifo", "first", "missing").collect()
    assert [tuple(g) for g in got] == [(1, 1, None)]


def test_signal_jobs(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (40, 512))
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "i long, samples array<double>")
    white = signal.whiten(df, "samples", 256, 64, 64.0, 16).collect()
    assert all(len(w.white) == 240 for w in white)
    assert 0.7 < np.std([w.white for w in white]) < 1.4
    psd = signal.welch(df.withColumn("all", F.lit(1)), "all", "samples", 64, 64.0, "mean").collect()
    assert np.mean([p.psd for p in psd[1:-1]]) == pytest.approx(2 / 64, rel=0.1)
    rows = df.select(F.lit("H1").alias("ifo"), "i", F.transform("samples", lambda v: v).alias("samples"))
    low = {g.i: g.samples for g in signal.resample(rows, "ifo", "i", "samples", 4, 15).collect()}
    h = np.array(signal.lowpass(15, 4))
    want = np.convolve(np.concatenate((np.zeros(7), x.ravel(), np.zeros(7))), h, "valid")[::4]
    assert np.allclose(np.concatenate([low[i] for i in range(40)]), want)


def test_aligned_and_sliced(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "s array<double>")
    assert x.select(signal.slice_pad(F.col("s"), F.lit(1), 2, 3)).first()[0] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert x.select(signal.align(F.col("s"), 6, F.lit(2), 2)).first()[0] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    assert x.select(signal.project(F.col("s"), F.col("s"), F.lit(1.0), F.lit(1.0), F.lit(1))).first()[0] == [0.0, 2.0, 4.0, 6.0]


def test_detectors_respond_best_to_what_is_overhead(spark):
    for d, (x, y, z) in detectors.PLACE.items():
        ra, dec = math.atan2(y, x), math.asin(z / math.sqrt(x * x + y * y + z * z))
        row = spark.range(1).selectExpr(f"{ra!r} as ra", f"{dec!r} as dec", "0.4 as psi").selectExpr(*detectors.antenna(d), detectors.delay(d)).first()
        assert math.hypot(row[0], row[1]) == pytest.approx(1, abs=0.01)
        assert row[2] == pytest.approx(-math.sqrt(x * x + y * y + z * z) / 299792458.0)
        assert np.trace(detectors.RESPONSE[d]) == pytest.approx(0, abs=1e-5)


def test_hooks(spark):
    half = lambda df: df.withColumn("kernel", F.transform("kernel", lambda x: x / 2))
    rows = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],)], "s array<double>")
    assert signal.kernels(rows, "s", 2, F.lit(1), [half, half]).first().kernel == [0.5, 1.0]
    drawn = priors.draw(spark.range(500), "id", {"a": priors.uniform(0.0, 2.0)}, 1, lambda d: d.withColumn("b", F.col("a") * 10), F.col("b") > 5)
    assert 250 < drawn.count() < 500 and drawn.where("b <= 5 or b != a * 10").count() == 0
    x = np.random.default_rng(4).normal(10, 2, 400)
    df, grid = spark.createDataFrame([(float(v),) for v in x], "s double"), spark.range(81).selectExpr("id / 4.0D as pt")
    model = sensitivity.Density("s", grid)
    got = model.apply(spark.createDataFrame([(10.1,), (13.0,)], "s double"), model.fit(df)).orderBy("s").collect()
    h = x.std(ddof=1) * 400**-0.2
    for g in got:
        assert g.pdf == pytest.approx(np.mean(np.exp(-(((g.s - x) / h) ** 2) / 2)) / h / math.sqrt(2 * math.pi), rel=0.03)


def test_cosmology(spark):
    # distances and redshifts are each other's inverses; at small redshifts distance is z c / H0
    z = spark.createDataFrame([(v,) for v in (0.001, 0.1, 0.5, 1.0, 1.9)], "z double")
    d = cosmology.at_redshift(z, F.col("z"), "distance", "d")
    back = {r.z: (r.d, r.back) for r in cosmology.redshift_at(d, "d", "back").collect()}
    assert all(b == pytest.approx(k, rel=1e-3) for k, (_, b) in back.items())
    assert back[0.001][0] == pytest.approx(0.001 * 299792.458 / 67.74, rel=2e-3)
    # fixed values: luminosity distances of the same model by its integral, in Mpc
    for k in (0.1, 0.5, 1.0):
        x = np.linspace(0, k, 20001)
        f = 1 / np.sqrt(cosmology.MATTER * (1 + x) ** 3 + 1 - cosmology.MATTER)
        assert back[k][0] == pytest.approx((1 + k) * 299792.458 / 67.74 * np.sum((f[1:] + f[:-1]) / 2) * k / 20000, rel=1e-5)
    box = spark.createDataFrame([(0.0, 0.05)], "a double, b double")
    v = cosmology.volume_between(box, F.col("a"), F.col("b"), F.lit(-math.pi / 2), F.lit(math.pi / 2), "v").first().v
    assert 0.9 < v / (4 / 3 * math.pi * (0.05 * 299792.458 / 67.74) ** 3) < 1


def test_priors(spark):
    draws = {"a": priors.uniform(2.0, 3.0), "b": priors.power_law(-2.0, 5.0, 50.0), "c": priors.cosine(), "d": priors.sine(), "e": priors.log_uniform(1.0, 10.0), "f": priors.triangular(0.0, 1.0, 3.0), "g": priors.normal(1.0, 2.0), "h": priors.in_volume(2.0), "k": priors.log_normal(0.0, 0.1)}
    p = priors.draw(spark.range(4000), "id", draws, 1).toPandas()
    assert p.a.between(2, 3).all() and p.b.between(5, 50).all() and p.e.between(1, 10).all() and p.f.between(0, 3).all()
    assert p.a.mean() == pytest.approx(2.5, abs=0.02) and p.c.mean() == pytest.approx(0, abs=0.04) and p.d.mean() == pytest.approx(math.pi / 2, abs=0.04)
    assert p.g.mean() == pytest.approx(1, abs=0.1) and p.g.std() == pytest.approx(2, abs=0.1) and p.f.mean() == pytest.approx(4 / 3, abs=0.05)
    assert (p.h < 1).mean() == pytest.approx(1 / 8, abs=0.03) and p.k.median() == pytest.approx(1, abs=0.02)


def test_sampling(spark):
    df = spark.range(100).withColumn("file", F.col("id") % 3)
    assert ledger.sample(df, 10, "id").count() == 10 and ledger.sample_with_replacement(df, 250, "id").count() == 250
    runs = sampling.contiguous_runs(df, "file", "id", 5, 8).collect()
    assert len(runs) == 40
    marked = sampling.accept_until(df.withColumn("ok", F.col("id") % 2 == 0), "ok", 5, "id").collect()
    assert sorted(r.id for r in marked) == list(range(9))


def test_max_pool_and_auroc(spark):
    y = np.random.default_rng(1).normal(size=37)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "s long, i long, y double")
    got = {r.w: r.y for r in series.max_pool(df, 8, ["s"]).collect()}
    starts = [k * 4 for k in range(10) if k == 0 or (k - 1) * 4 + 8 < 37]
    assert [got[k] for k in range(len(got))] == [y[s : s + 8].max() for s in starts]
    roc = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1)], "score double, y int")
    assert series.auroc(roc, "score", "y").first()[0] == pytest.approx(3.5 / 6)


