"""The live search: blocks of samples as they arrive, by detector, with state across micro-batches.

Walkers' state is a small value per key, processors' (``stateful``) is kept piece by piece; rows of a micro-batch are sorted
before they meet it, so results don't depend on where batches end. Lateness is what the
watermark allows; a block that comes after a newer one of its detector is dropped, as the
search has moved on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import fixed, folder

LATENESS = "10 seconds"


def follow(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class rocks:
    """While a stream starts, its session keeps state in RocksDB: off the heap, and a change at a time. Then the setting is as before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.was = spark, spark.conf.get(_PROVIDER, None)

    def __enter__(self) -> None:
        self.spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_: object) -> None:
        if self.was is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.was)


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes micro-batches to a folder each, by number: a batch that comes again after a failure replaces its own."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there and give its rows, with the number of the micro-batch that made them."""
    spark = stream.sparkSession
    path = folder(spark, "stream")
    keep = sink(f"{path}/rows")

    def put(batch: DataFrame, number: int) -> None:
        if each is not None:
            batch.persist()
            each(batch, number)
        keep(batch, number)
        if each is not None:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put)
    with rocks(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{kinds}, _batch int").parquet(f"{path}/rows")


def ending(spark: SparkSession, path: str, schema: str, time: str, at: datetime) -> None:
    """Close a folder's stream: a row that has nothing but a time, so late that the watermark passes all that still waits.

    It must reach the watermark, so nothing after it may filter it out; it joins nothing, and as an event waits for ever.
    """
    row = spark.range(1).select(F.lit(at).cast("timestamp").alias(time))
    kinds = [f.split(" ", 1) for f in schema.split(", ")]
    row.select(*(F.col(n) if n == time else F.lit(None).cast(t).alias(n) for n, t in kinds)).write.mode("append").parquet(path)


def assemble(blocks: DataFrame, time: str, span: str, key: str, samples: str, detectors: int) -> DataFrame:
    """(second, parts, complete): for each span of time the samples of the detectors that have come, by detector, in update mode.

    A block that is sent again counts once.
    """
    rows = blocks.withWatermark(time, LATENESS).groupBy(F.window(time, span).alias("w"))
    parts = rows.agg(F.sort_array(F.collect_set(F.struct(key, samples))).alias("parts"))  # a block per detector
    return parts.select(F.col("w.start").alias("second"), "parts", (F.size(F.array_distinct(F.transform("parts", lambda p: p[key]))) == detectors).alias("complete"))


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of updates the last one per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "_batch")), "_batch").alias("_r")).select("_r.*")


class Walker:
    """A stateful operator per detector: subclasses say what a block does to the state and what it emits."""

    #: How long without a block, in event time, until ``silence``; never if None.
    wait: str | None = None
    #: DDL of the state and of the output.
    state = "last long"
    output = "ifo long, i long"

    def start(self) -> tuple:
        return (-1,)

    def block(self, state: list, i: int, y: float, ready: bool) -> Iterator[tuple]:
        raise NotImplementedError

    def silence(self, state: list) -> Iterator[tuple]:
        return iter(())

    def apply(self, stream: DataFrame) -> DataFrame:
        names = [f.split()[0] for f in self.output.split(", ")]
        wait = pd.Timedelta(self.wait) // pd.Timedelta("1ms") if self.wait else None

        def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            now = list(state.get) if state.exists else list(self.start())
            out = []
            if state.hasTimedOut:
                out += [(key[0], *x) for x in self.silence(now)]
                state.update(tuple(now))
                if out:
                    yield pd.DataFrame(out, columns=names)
                return
            rows = pd.concat(parts).sort_values("i", kind="stable")
            for i, y, ready in zip(rows["i"].tolist(), rows["y"].tolist(), rows["ready"].tolist()):
                if i > now[0]:
                    out += [(key[0], *x) for x in self.block(now, i, y, ready)]
                    now[0] = i
            state.update(tuple(now))
            if wait:
                newest = rows["ts"].max()
                newest = newest.tz_localize("UTC") if newest.tzinfo is None else newest
                state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
            if out:
                yield pd.DataFrame(out, columns=names)

        timed = stream.withWatermark("ts", LATENESS) if wait else stream
        return timed.groupBy("ifo").applyInPandasWithState(run, self.output, self.state, "append", "EventTimeTimeout" if wait else "NoTimeout")


class Gaps(Walker):
    """A row for each stretch of missing blocks; what follows starts anew.

    With ``wait`` a stretch is also told, once, when no block came for so long in event time by the watermark:
    its row has a null length, and the stretch is not told again when a block ends it.
    """

    state, output = "last long, told boolean", "ifo long, first long, missing long"

    def __init__(self, wait: str | None = None):
        self.wait = wait

    def start(self):
        return -1, False

    def block(self, state, i, y, ready):
        if state[0] >= 0 and i > state[0] + 1 and not state[1]:
            yield state[0] + 1, i - state[0] - 1
        state[1] = False

    def silence(self, state):
        if state[0] >= 0 and not state[1]:
            state[1] = True
            yield state[0] + 1, None


class Boxcar(Walker):
    """Trailing means of the last ``width`` scores, zeros before the first; with ``every`` only of every so-manieth score, averaged over ``width`` of those."""

    state, output = "last long, seen long, buffer array<double>", "ifo long, i long, y double"

    def __init__(self, width: int, every: int = 1):
        self.width, self.every = width, every

    def start(self):
        return -1, 0, []

    def block(self, state, i, y, ready):
        if state[1] % self.every == 0:
            state[2] = (list(state[2]) + [y])[-self.width :]
            yield i, float(sum(state[2]) / self.width)
        state[1] += 1


class AllReady(Walker):
    """Whether all of the last ``n`` blocks were ready."""

    state, output = "last long, flags array<boolean>", "ifo long, i long, usable boolean"

    def __init__(self, n: int):
        self.n = n

    def start(self):
        return -1, []

    def block(self, state, i, y, ready):
        state[1] = (list(state[1]) + [bool(ready)])[-self.n :]
        yield i, len(state[1]) == self.n and all(state[1])


class Status(Walker):
    """Transitions in and out of readiness; a detector begins ready."""

    state, output = "last long, ready boolean", "ifo long, i long, ready boolean"

    def start(self):
        return -1, True

    def block(self, state, i, y, ready):
        if bool(ready) != state[1]:
            state[1] = bool(ready)
            yield i, state[1]


def around(events: DataFrame, blocks: DataFrame, before: str, after: str) -> DataFrame:
    """Stream-stream join: the blocks of an event's detector from ``before`` it to ``after`` it."""
    e = events.select(F.col("ifo").alias("e_ifo"), F.col("i").alias("e_i"), F.col("ts").alias("e_ts")).withWatermark("e_ts", LATENESS)
    b = blocks.select("ifo", "i", "ts", "y").withWatermark("ts", LATENESS)
    return e.join(b, F.expr(f"e_ifo = ifo and ts >= e_ts - interval {before} and ts <= e_ts + interval {after}"))


def awaited(events: DataFrame, posteriors: DataFrame, keys: Sequence[str], wait: str) -> DataFrame:
    """Left outer stream-stream join: each event with its posterior if that comes at most ``wait`` after it, else with nulls; a null key equals none.

    The join is on one text that names the keys, which is never null: rows whose key is null can stop others of their partition from being let go.
    """
    name = F.to_json(F.struct(*keys))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    e = events.withColumn("_name", name).withWatermark("ts", LATENESS)
    p = posteriors.select(F.when(whole, name).otherwise("").alias("p_name"), *(c for c in posteriors.columns if c not in keys)).withWatermark("p_ts", LATENESS)
    return e.join(p, F.expr(f"_name = p_name and p_ts >= ts and p_ts <= ts + interval {wait}"), "left").drop("_name", "p_name")


#: Values in a node of a table of steps.
NODE = 256


def far_steps(background: DataFrame, stat: str, threshold: float, node: int = NODE) -> list[DataFrame]:
    """How many of a background, from the threshold on, are at least a value: a tree of tables, from the root's to the leaves'.

    Rows are nodes (_node, _keys, _upto) of equal depth, made from ranks: a leaf has ``node`` of the background's different values in falling order and the counts up to each,
    an inner node the largest value of each of as many nodes below. So rows have a fixed size, and a look-up reads one per level.
    """
    from ..operators.ranks import running

    values = background.where(F.col(stat) >= threshold).groupBy(F.col(stat).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = fixed(running(values, "_x", {"_upto": "_n", "_rank": "1L"}), "steps").withColumn("_child", F.col("_rank") - 1)
    levels, entries, n = [], ranked, ranked.count()
    while True:
        rows = entries.groupBy(F.expr(f"_child div {node}").alias("_node")).agg(F.sort_array(F.collect_list(F.struct("_child", "_x", "_upto"))).alias("_e"))
        rows = fixed(rows.select("_node", F.col("_e._x").alias("_keys"), F.col("_e._upto").alias("_upto")), "steps")
        levels.insert(0, rows)
        if n <= node:
            return levels
        n = -(-n // node)
        entries = rows.select(F.col("_node").alias("_child"), F.col("_keys")[0].alias("_x"), F.lit(None).cast("long").alias("_upto"))


def with_far(events: DataFrame, background: DataFrame, stat: str, threshold: float, tb: float, node: int = NODE) -> DataFrame:
    """Alarms per second of events (y) by a background: down the tree of ``far_steps`` by an equi-join per level."""
    levels = far_steps(background, stat, threshold, node)
    names = events.columns
    found = events.withColumns({"_y": F.greatest(F.col("y"), F.lit(threshold)), "_node": F.lit(0).cast("long")})
    for depth, rows in enumerate(levels):
        # the upper levels have a bounded size
        rows = F.broadcast(rows) if node ** (depth + 1) <= 1 << 16 else rows
        at = F.size(F.filter(F.coalesce("_keys", F.array().cast("array<double>")), lambda k: k >= F.col("_y")))
        found = found.join(rows, "_node", "left").withColumn("_at", at)
        if depth < len(levels) - 1:
            found = found.withColumn("_node", F.when(F.col("_at") > 0, F.col("_node") * node + F.col("_at") - 1)).select(*names, "_y", "_node")
    count = F.when(F.col("_at") > 0, F.element_at("_upto", F.greatest(F.col("_at"), F.lit(1))))
    return found.withColumn("far", F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)) / tb).select(*names, "far")


def _newest(rows: DataFrame, key: str, version: Sequence[str], sums: Sequence[str]) -> DataFrame:
    last = F.max_by("newest", F.struct(*(f"newest.{c}" for c in version))).alias("newest")
    return rows.groupBy(F.col(f"newest.{key}").alias("_key")).agg(last, *(F.sum(k).alias(k) for k in sums)).drop("_key")


def _has(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _kept(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """All rows that count: the last base (of those before a batch) and the batches after it; and that base's number, -1 for none."""
    base, rows = -1, None
    if _has(spark, f"{path}/bases"):
        bases = spark.read.parquet(f"{path}/bases")
        last = bases.where(F.col("_base") < before if before is not None else F.lit(True)).agg(F.max("_base")).first()[0]
        if last is not None:
            base, rows = int(last), bases.where(F.col("_base") == last).drop("_base")
    if _has(spark, f"{path}/batches"):
        more = spark.read.parquet(f"{path}/batches")
        more = more.where((F.col("_batch") > base) & (F.col("_batch") <= before if before is not None else F.lit(True))).drop("_batch")
        rows = more if rows is None else rows.unionByName(more)
    return rows, base


def upsert(path: str, key: str, version: Sequence[str], sums: dict[str, str], every: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``drain`` or ``monitor``: per micro-batch and key the newest row and sums of expressions; a batch that comes again replaces its own.

    After ``every`` batches all so far become one base, so what ``current`` reads stays as many rows as there are keys, and as many batches as ``every``.
    """

    def put(batch: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct(*batch.columns), F.struct(*version)).alias("newest")
        rows = batch.groupBy(key).agg(newest, *(F.sum(F.expr(e)).alias(k) for k, e in sums.items())).drop(key)
        rows.write.mode("overwrite").parquet(f"{path}/batches/_batch={number}")
        if number % every == every - 1:
            kept, _ = _kept(batch.sparkSession, path, before=number)
            _newest(kept, key, version, list(sums)).write.mode("overwrite").parquet(f"{path}/bases/_base={number}")

    return put


def current(spark: SparkSession, path: str, key: str, version: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The table that ``upsert`` keeps: of all batches the newest row per key, and the sums over all."""
    rows, _ = _kept(spark, path)
    return _newest(rows, key, version, sums).select("newest.*", *sums)


def monitor(stream: DataFrame, path: str, cadence: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``put`` on what has come every ``cadence``, until the query is stopped."""
    with rocks(stream.sparkSession):
        return stream.writeStream.option("checkpointLocation", f"{path}/_state").foreachBatch(put).trigger(processingTime=cadence).start()
