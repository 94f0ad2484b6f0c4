"""The live search, against walks over the same blocks: whatever the micro-batches, with failures and at the end."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.streaming import live, stateful

SCHEMA = "ifo long, i long, ts timestamp, y double, ready boolean, sig double"
START = datetime.datetime(2024, 1, 1)


def at(k):
    return START + datetime.timedelta(seconds=10 * k)


def files(spark, path, parts):
    """Micro-batches in this order: files are taken by their times."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        if len(parts) > 1:
            time.sleep(1.1)
    return live.follow(spark, str(path), SCHEMA, 1)


def some_blocks(n=150, seed=2):
    r = np.random.default_rng(seed)
    return [(ifo, i, at(i), float(r.integers(0, 10)), bool(r.random() > 0.1), float(r.integers(0, 10))) for i in range(n) for ifo in (0, 1) if r.random() > 0.05]


@pytest.mark.parametrize("n", [1, 4])
def test_rolling_buffer(spark, tmp_path, n):
    rows = some_blocks()
    parts = [[rows[j] for j in part.tolist()] for part in np.array_split(np.arange(len(rows)), n)]
    parts[0] = parts[0][::-1]  # within a micro-batch the order doesn't matter
    got = live.drain(stateful.Rolling(6).apply(files(spark, tmp_path / "in", parts))).collect()
    buffer, last, want = {0: [], 1: []}, {}, []
    for ifo, i, _, y, ok, _ in rows:
        buffer[ifo] = (buffer[ifo] if last.get(ifo) == i - 1 else []) + [y]
        buffer[ifo], last[ifo] = (buffer[ifo][-6:] if ok else []), i
        want.append((ifo, i, len(buffer[ifo]), len(buffer[ifo]) == 6, sum(buffer[ifo])))
    assert sorted(tuple(g)[:5] for g in got) == sorted(want)
    assert any(w[3] for w in want)


def events(rows, threshold, frame, period):
    """What is detected in one detector's blocks (i, y, ready, sig), by definition."""
    out, held, detecting, last = [], [], False, -(10**9)

    def event(i, y, partial):
        nonlocal detecting, last
        detecting = False
        if i - last >= period:
            last = i
            out.append((i, y, partial))

    for i, y, ready, sig in rows:
        if not ready:
            if detecting and held:
                event(held[-1][0], held[-1][2], True)
            held, detecting = [], False
            continue
        if held and i != held[-1][0] + 1:
            held = []
        held.append((i, y, sig))
        if len(held) == frame:
            peak = [h[1] for h in held].index(max(h[1] for h in held))
            if max(h[2] for h in held) >= threshold:
                if peak < frame - 1:
                    event(held[peak][0], max(h[2] for h in held), False)
                else:
                    detecting = True
            held = held[-1:] if detecting else []
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_detection_over_two_scores(spark, tmp_path, n):
    rows = some_blocks(400, 5)
    parts = [[rows[j] for j in part.tolist()] for part in np.array_split(np.arange(len(rows)), n)]
    got = live.drain(stateful.Detect(7.0, 3, 4).apply(files(spark, tmp_path / "in", parts))).collect()
    want = [(ifo, *e) for ifo in (0, 1) for e in events([(i, y, ok, s) for k, i, _, y, ok, s in rows if k == ifo], 7.0, 3, 4)]
    assert sorted(tuple(g)[:4] for g in got) == sorted(want)
    assert {w[3] for w in want} == {True, False} and len(want) > 40


def test_detections_by_hand(spark, tmp_path):
    scores = [0, 1, 7, 2, 0, 0, 1, 9, 10, 3, 0, 0, 0, 0, 8]
    rows = [(0, i, at(i), float(y), True, float(y)) for i, y in enumerate(scores)] + [(0, 15, at(15), 0.0, False, 0.0)]
    got = live.drain(stateful.Detect(5.0, 4, 6).apply(files(spark, tmp_path / "in", [rows]))).orderBy("i").collect()
    # the peak at 2; that at 7 ends its frame, so the next frame, which begins with it, decides for 8; that at 14 still rises when readiness goes
    assert [tuple(g)[:4] for g in got] == [(0, 2, 7.0, False), (0, 8, 10.0, False), (0, 14, 8.0, True)]


def test_silence_ends_a_detectors_state(spark, tmp_path):
    """A detector that rises and falls silent is told of by its timer; what comes later begins anew."""
    rising = [(1, k, at(k), float(k), True, float(k)) for k in range(4)]
    other = lambda a, b: [(0, k, at(k), 0.0, True, 0.0) for k in range(a, b)]
    parts = [rising + other(0, 4), other(4, 40), other(40, 41), other(41, 42) + [(1, 42, at(42), 9.0, True, 9.0)]]
    stream = files(spark, tmp_path / "in", parts)
    got = live.drain(stateful.Detect(2.0, 4, 2, wait="60 seconds").apply(stream)).collect()
    assert [tuple(g)[:4] for g in got] == [(1, 3, 3.0, True)]
    rolled = live.drain(stateful.Rolling(3, wait="60 seconds").apply(stream)).where("ifo = 1").orderBy("i").collect()
    assert [(g.i, g.filled, g.total) for g in rolled] == [(0, 1, 0.0), (1, 2, 1.0), (2, 3, 3.0), (3, 3, 6.0), (42, 1, 9.0)]


def test_samples_side_by_side(spark, tmp_path):
    rows = [("H1", at(0), [1.0, 2.0]), ("L1", at(0), [3.0]), ("H1", at(1), [5.0]), ("H1", at(0), [1.0, 2.0])]
    spark.createDataFrame(rows, "ifo string, ts timestamp, x array<double>").write.parquet(str(tmp_path / "in"))
    stream = live.follow(spark, str(tmp_path / "in"), "ifo string, ts timestamp, x array<double>")
    got = live.newest(live.drain(live.assemble(stream, "ts", "10 seconds", "ifo", "x", 2), "update"), "second").orderBy("second").collect()
    assert [([tuple(p) for p in g.parts], g.complete) for g in got] == [([("H1", [1.0, 2.0]), ("L1", [3.0])], True), ([("H1", [5.0])], False)]


def test_what_waits_is_told_at_the_end(spark, tmp_path):
    kinds = "ifo long, i long, ts timestamp, y double"
    rows = [(0, k, at(k), float(k)) for k in range(5)] + [(0, None, at(2), 9.0)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "events"))
    spark.createDataFrame([(0, 1, 0.5, at(1) + datetime.timedelta(seconds=4)), (0, 2, 0.7, at(2) + datetime.timedelta(seconds=40))], "ifo long, i long, low double, p_ts timestamp").write.parquet(str(tmp_path / "post"))
    for ends, want in ((False, None), (True, {(0, None), (1, 0.5), (2, None), (3, None), (4, None), (None, None)})):
        if ends:
            live.ending(spark, str(tmp_path / "events"), kinds, "ts", datetime.datetime(2100, 1, 1))
            live.ending(spark, str(tmp_path / "post"), "ifo long, i long, low double, p_ts timestamp", "p_ts", datetime.datetime(2100, 1, 1))
        e, p = live.follow(spark, str(tmp_path / "events"), kinds), live.follow(spark, str(tmp_path / "post"), "ifo long, i long, low double, p_ts timestamp")
        got = {(g.i, g.low) for g in live.drain(live.awaited(e, p, ["ifo", "i"], "10 seconds")).collect()}
        if ends:
            assert got == want
        else:
            assert len(got) < 6


@pytest.mark.parametrize("node", [2, 5, 256])
def test_rates_by_a_tree_of_steps(spark, node):
    r = np.random.default_rng(6)
    back = np.round(r.exponential(20, 300), 1).tolist() + [15.5] * 40 + [None, 3.0]
    asked = [10.0, 10.05, 15.5, 15.49, 60.0, 1e9, *r.uniform(10, 90, 30).tolist(), *back[:20]]
    frame = spark.createDataFrame([(k, float(y)) for k, y in enumerate(asked)], "k long, y double")
    background = spark.createDataFrame([(x,) for x in back], "x double")
    got = {g.k: g.far for g in live.with_far(frame, background, "x", 10.0, 2.0, node).collect()}
    kept = [x for x in back if x is not None and x >= 10]
    assert got == {k: max(sum(x >= y for x in kept), 1) / 2.0 for k, y in enumerate(asked)}
    assert {g.far for g in live.with_far(frame, background.limit(0), "x", 10.0, 2.0, node).collect()} == {0.5}
    for level in live.far_steps(background, "x", 10.0, node):
        assert level.agg(F.max(F.size("_keys"))).first()[0] <= node


def test_a_repeated_batch_replaces_its_own(spark, tmp_path):
    batch = spark.createDataFrame([(0, 1, 2.0), (0, 2, 5.0), (1, 1, 7.0)], "k long, v long, x double")
    put = live.sink(str(tmp_path / "rows"))
    for number in (0, 1, 1, 1):
        put(batch, number)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6
    for every in (2, 64):
        path = str(tmp_path / f"table{every}")
        table = live.upsert(path, "k", ["v"], {"total": "x"}, every)
        for number in (0, 1, 1, 2, 3, 3, 4):
            table(batch.withColumn("v", F.col("v") + 10 * number), number)
        got = {(g.k, g.v, g.total) for g in live.current(spark, path, "k", ["v"], ["total"]).collect()}
        assert got == {(0, 42, 35.0), (1, 41, 35.0)}
    assert spark.read.parquet(f"{tmp_path}/table2/bases").select("_base").distinct().count() == 2
    assert live._kept(spark, f"{tmp_path}/table2")[0].count() == 4  # a base's two keys and one batch's


def test_the_monitor_keeps_its_cadence(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [some_blocks(5)])
    seen = []
    query = live.monitor(stream, str(tmp_path / "m"), "2 seconds", lambda batch, number: seen.append((time.time(), batch.count())))
    try:
        query.processAllAvailable()
        for k in range(2):
            spark.createDataFrame(some_blocks(3, k), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
    finally:
        query.stop()
    assert len(seen) >= 3 and all(b[0] - a[0] > 1.0 for a, b in zip(seen, seen[1:]))
    assert all(abs(a[0] / 2 - round(a[0] / 2)) < 0.5 for a in seen[1:])


def test_settings_stay(spark):
    was = spark.conf.get(live._PROVIDER)
    with live.rocks(spark):
        assert "RocksDB" in spark.conf.get(live._PROVIDER)
    assert spark.conf.get(live._PROVIDER) == was
