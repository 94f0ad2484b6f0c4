"""Jobs over series in blocks, against the same on whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import qtransform, signal, strain


def blocks(spark, x, size, gone=()):
    rows = [(ifo, k, x[ifo][k * size : (k + 1) * size].tolist()) for ifo in x for k in range(-(-len(x[ifo]) // size)) if k not in gone]
    return spark.createDataFrame(rows, "ifo string, block long, samples array<double>").repartition(3)


def whole(df, ifo):
    return np.concatenate([r.samples for r in df.where(F.col("ifo") == ifo).orderBy("block").collect()])


def test_pattern_of_ten_waveforms(spark):
    """27 s at 128 Hz from -1 s on; waveforms of 4 s, 1 s of which after their times 0, 5, 10, ..., of height 1, 2, ..."""
    rate, duration, start, length = 128, 4, -1, 27
    background = {"h1": np.zeros(length * rate), "l1": np.zeros(length * rate)}
    strain_rows = blocks(spark, background, 200)
    signals = [(ifo, math.floor((5.0 * k - start) * rate) - (duration - 2) * rate, [sign * (k + 1.0)] * (duration * rate)) for k in range(10) for ifo, sign in (("h1", 1), ("l1", -1))]
    out = strain.add_signals(strain_rows, spark.createDataFrame(signals, "ifo string, first long, wave array<double>").repartition(4), ["ifo"], "block", "samples", 200)
    h, low = whole(out, "h1"), whole(out, "l1")
    assert (h == -low).all() and len(h) == length * rate
    assert (h[: (duration - 1) * rate] == 1).all()  # its first second lies before the strain
    offset = (duration - 1) * rate
    for i in range(5):
        zero = offset + i * (duration + 1) * rate
        assert not h[zero : zero + rate].any()
        assert (h[zero + rate : zero + rate + duration * rate] == i + 2).all()
    assert zero + rate + duration * rate == len(h) + rate  # the last one's end is cut


def test_signals_that_overlap(spark):
    rng = np.random.default_rng(7)
    x = {"a": rng.normal(size=1000), "b": rng.normal(size=950)}
    want = {k: v.copy() for k, v in x.items()}
    signals = []
    for _ in range(400):
        ifo, first, wave = "ab"[int(rng.integers(2))], int(rng.integers(-80, 1100)), rng.normal(size=int(rng.integers(1, 260)))
        first = 500 if rng.random() < 0.3 else first  # many meet in one place
        signals.append((ifo, first, wave.tolist()))
        for k, w in enumerate(wave):
            if 0 <= first + k < len(want[ifo]):
                want[ifo][first + k] += w
    signals += [("a", None, [1.0]), ("a", 5, None), ("b", 5, []), ("c", 5, [1.0])]
    frame = spark.createDataFrame(signals, "ifo string, first long, wave array<double>").repartition(5)
    out = strain.add_signals(blocks(spark, x, 64), frame, ["ifo"], "block", "samples", 64)
    assert out.columns == ["ifo", "block", "samples"]
    for k in x:
        assert np.allclose(whole(out, k), want[k])
    same = strain.add_signals(blocks(spark, x, 64), frame.limit(0), ["ifo"], "block", "samples", 64)
    assert np.allclose(whole(same, "a"), x["a"])


def test_across_borders(spark):
    x = np.arange(300.0)
    df = blocks(spark, {"a": x}, 32)
    for size, stride in ((32, 8), (16, 16), (40, 16)):
        got = {(r.block, r.k): r.window for r in strain.windows(df, ["ifo"], "block", "samples", size, stride).collect()}
        starts = [b * 32 + k * stride for b, k in sorted(got)]
        assert starts == list(range(0, 300 - size + 1, stride))
        assert all(got[b, k] == x[b * 32 + k * stride :][:size].tolist() for b, k in got)
    for shift in (0, 5, 32, 77, -40):
        got = {r.block: r.samples for r in strain.shifted(df, ["ifo"], "block", "samples", shift, 32).collect()}
        for b in range(2, 5):
            assert got[b] == x[b * 32 + shift :][:32].tolist()
    near = {r.block: r for r in strain.beside(blocks(spark, {"a": x}, 32, gone=(4,)), ["ifo"], "block", "samples", 3, 2).collect()}
    assert near[1]._before == [29.0, 30.0, 31.0] and near[1]._after == [64.0, 65.0]
    assert near[0]._before is None and near[3]._after is None and near[5]._before is None
    low = {r.block: r.samples for r in signal.resample(blocks(spark, {"a": x}, 32, gone=(4,)), "ifo", "block", "samples", 4, 15).collect()}
    y = x.copy()
    y[128:160] = 0
    want = np.convolve(np.concatenate((np.zeros(7), y, np.zeros(7))), signal.lowpass(15, 4), "valid")[::4]
    assert np.allclose(low[3], want[24:32]) and np.allclose(low[5], want[40:48])


def test_one_density_for_both_series(spark):
    """Signals don't change the density that they are whitened by, which is the running median of the blocks before."""
    rng = np.random.default_rng(3)
    size, frame, history = 128, 32, 3
    x = np.convolve(rng.normal(size=20 * size + 40), np.hanning(9), "same")[: 20 * size]
    loud = x.copy()
    loud[5 * size : 12 * size] += 50 * np.sin(np.arange(7 * size))
    plain, with_signal = blocks(spark, {"a": x}, size), blocks(spark, {"a": loud}, size)
    psd = strain.rolling_psd(plain, ["ifo"], "block", "samples", frame, 64.0, history)
    known = {r.block: np.array(r.psd) for r in psd.collect()}
    w = signal.hann(frame)
    for b in (3, 7, 20):
        frames = [x[k * size + s :][:frame] for k in range(b - history, b) for s in range(0, size - frame + 1, frame // 2)]
        want = np.median([np.abs(np.fft.rfft(f * w)) ** 2 for f in frames], 0) * 2 / (64.0 * (w * w).sum())
        assert np.allclose(known[b], want)
    assert min(known) == history
    both = plain.select("*", F.lit("plain").alias("kind")).unionByName(with_signal.select("*", F.lit("loud").alias("kind")))
    out = strain.whiten(both, psd, ["ifo"], "block", "samples", 64.0, 16, apart=["kind"])
    white = {(r.kind, r.block): np.array(r.white) for r in out.collect()}
    assert {b for _, b in white} == set(range(history, 19)) and all(len(v) == size for v in white.values())
    noise = np.concatenate([white["plain", b] for b in range(history, 19)])
    assert 0.6 < noise.std() < 1.5 and abs(np.corrcoef(noise[:-1], noise[1:])[0, 1]) < 0.25  # the series itself: 0.95
    assert white["loud", 8].std() > 5 * white["plain", 8].std() and np.allclose(white["loud", 3], white["plain", 3])


def test_planes_by_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 96))
    listed = qtransform.rows(6.0, 96, 32.0, cycles=4.0)
    assert listed and all(r.tiles >= 2 * r.half + 1 and r.bin + r.half <= 48 and r.bin >= r.half for r in listed)
    assert sorted(r.bin for r in listed) == [r.bin for r in listed]
    for r, got in zip(listed, qtransform.plane(x, listed)):
        for k in range(2):
            spectrum = [sum(v * np.exp(-2j * math.pi * f * i / 96) for i, v in enumerate(x[k])) for f in range(49)]
            z = [abs(sum(spectrum[r.bin + d] * (1 - (d / r.half) ** 2) ** 2 * np.exp(2j * math.pi * d * t / r.tiles) for d in range(-r.half, r.half + 1))) ** 2 for t in range(r.tiles)]
            assert np.allclose(got[k], np.array(z) / np.median(z))
    assert qtransform.rows(2.0, 96, 32.0) == [] and qtransform.rows(6.0, 96, 32.0) == []


def test_the_loudest_plane(spark):
    """A short burst is loudest at a low Q, a long tone at a high one, and at its own time and frequency."""
    t = np.arange(512) / 128.0
    rng = np.random.default_rng(2)
    made = {"burst": 6 * np.exp(-(((t - 1.0) * 14) ** 2)) * np.cos(2 * math.pi * 20 * t), "tone": 1.6 * np.exp(-(((t - 2.0) / 0.35) ** 2)) * np.cos(2 * math.pi * 30 * t)}
    df = spark.createDataFrame([(k, (v + rng.normal(0, 0.2, 512)).tolist()) for k, v in made.items()] + [("none", None), ("empty", [])], "name string, x array<double>")
    got = {r.name: r.s for r in df.select("name", qtransform.scan(F.col("x"), [4.0, 30.0], 128.0, cycles=2.0).alias("s")).collect()}
    assert got["burst"].q == 4.0 and got["tone"].q == 30.0 and got["none"].q is None and got["empty"].q is None
    for name, when, f in (("burst", 1.0, 20), ("tone", 2.0, 30)):
        listed = qtransform.rows(got[name].q, 512, 128.0, cycles=2.0)
        row, tile, _ = max(((i, j, e) for i, line in enumerate(got[name].tiles) for j, e in enumerate(line)), key=lambda x: x[2])
        assert abs(tile / listed[row].tiles * 4 - when) < 0.3 and abs(listed[row].bin / 4 - f) < 6
    grid = df.where("name = 'burst'").select(qtransform.scan(F.col("x"), [4.0], 128.0, cycles=2.0, shape=(16, 24)).alias("s")).first().s.tiles
    assert np.array(grid).shape == (16, 24) and abs((np.argmax(np.max(grid, 0)) + 0.5) / 24 * 4 - 1.0) < 0.3


def test_grid_of_a_plane():
    listed = [qtransform.Row(2, 1, 4), qtransform.Row(4, 1, 4), qtransform.Row(8, 1, 8)]
    lines = [np.array([1.0, 2, 3, 4]), np.array([5.0, 5, 5, 5]), np.arange(8.0)]
    out = qtransform.on_grid(lines, listed, 5, 4)
    assert np.allclose(out[0], [1.5, 2.5, 3.5, 2.5]) and np.allclose(out[2], 5) and np.allclose(out[4], [1, 3, 5, 7])
    assert np.allclose(out[1], (out[0] + out[2]) / 2)


def test_scores_side_by_side(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0), (2, "b", 3.0)], "k long, kind string, s double")
    assert {tuple(r) for r in signal.paired(df, ["k"], "kind", ["a", "b"], "s").collect()} == {(1, 0.5, 2.0), (2, None, 3.0)}
