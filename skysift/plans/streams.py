"""Streaming queries: blocks of five minutes of the driver's events, detector by detector, replayed as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import matching
from ..sources.store import folder
from ..streaming import live, stateful
from .registry import Views, query

col = F.col
_SCHEMA = "ifo long, i long, ts timestamp, y double, ready boolean, sig double"
_BLOCKS = """
, blocks as (
  select user_id % 2 as ifo, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 300000000 as i, round(max(value), 4) as y, not bool_or(event_type = 'error' and value > 60) as ready
  from events where value is not null group by 1, 2),
lagged as (select *, lag(i) over w as before, row_number() over w - 1 as n, round(avg(y) over (partition by ifo order by i rows between 2 preceding and current row), 4) as sig from blocks window w as (partition by ifo order by i))
"""


def r(x, n=6):
    return F.round(x, n)


def blocks(v: Views) -> DataFrame:
    """Per detector and block its loudest score, a score that looks back over three blocks, and whether all was well."""
    block = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 300000000")
    rows = v.events.where("value is not null").withColumns({"ifo": col("user_id") % 2, "i": block})
    rows = rows.groupBy("ifo", "i").agg(F.round(F.max("value"), 4).alias("y"), (~F.bool_or((col("event_type") == "error") & (col("value") > 60))).alias("ready"))
    once = matching.earlier(rows, ["ifo"], "i", {"y1": col("y")}, 4096)
    both = matching.earlier(once, ["ifo"], "i", {"y2": col("y1")}, 4096)
    n = 1 + col("y1").isNotNull().cast("int") + col("y2").isNotNull().cast("int")
    mean = F.round((col("y") + F.coalesce("y1", F.lit(0.0)) + F.coalesce("y2", F.lit(0.0))) / n, 4)
    return both.select("ifo", "i", F.timestamp_seconds(col("i") * 300 + 1704067200).alias("ts"), "y", "ready", mean.alias("sig"))


def stream(v: Views, files: int = 3, per_batch: int | None = None, ends: bool = False) -> DataFrame:
    path = folder(v.spark, "frames")
    blocks(v).repartition(files).write.parquet(path)
    if ends:
        live.ending(v.spark, path, _SCHEMA, "ts", datetime(2100, 1, 1))
    return live.follow(v.spark, path, _SCHEMA, per_batch)


def walked(v: Views, walker: live.Walker | stateful.Processor) -> DataFrame:
    return live.drain(walker.apply(stream(v))).drop("_batch")


@query("stream_blocks", """
, p as (select user_id % 2 as ifo, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 300000000 as i, list(value order by ts, event_id) as x from events where value is not null group by 1, 2)
select i, count(*) as n, count(*) = 2 as complete, any_value(len(x)) filter (ifo = 0) as n0, any_value(len(x)) filter (ifo = 1) as n1,
  round(any_value(x[-1]) filter (ifo = 0), 4) as last0, round(any_value(x[-1]) filter (ifo = 1), 4) as last1, round(sum(list_sum(x)), 4) as total from p group by i
""")
def stream_blocks(v: Views):
    """The samples of all detectors of each five minutes, beside each other."""
    block = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 300000000")
    rows = v.events.where("value is not null").withColumns({"ifo": col("user_id") % 2, "i": block})
    rows = rows.groupBy("ifo", "i").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    path = folder(v.spark, "samples")
    rows.select("ifo", F.timestamp_seconds(col("i") * 300 + 1704067200).alias("ts"), col("s.value").alias("samples")).repartition(3).write.parquet(path)
    came = live.follow(v.spark, path, "ifo long, ts timestamp, samples array<double>")
    found = live.newest(live.drain(live.assemble(came, "ts", "5 minutes", "ifo", "samples", 2), "update"), "second")
    of = lambda ifo: F.get(F.filter("parts", lambda p: p["ifo"] == ifo), F.lit(0))["samples"]
    length = lambda x: F.when(x.isNotNull(), F.size(x).cast("long"))
    total = F.aggregate(F.flatten("parts.samples"), F.lit(0.0), lambda s, x: s + x)
    return found.select(
        ((F.unix_timestamp("second") - 1704067200) / 300).cast("long").alias("i"), F.size("parts").cast("long").alias("n"), "complete", length(of(0)).alias("n0"), length(of(1)).alias("n1"),
        r(F.try_element_at(of(0), F.lit(-1)), 4).alias("last0"), r(F.try_element_at(of(1), F.lit(-1)), 4).alias("last1"), r(total, 4).alias("total"),
    )


@query("stream_frames", _BLOCKS + "select ifo, i, y from blocks")
def stream_frames(v: Views):
    return live.drain(stream(v, files=4, per_batch=2)).select("ifo", "i", "y")


@query("replay_frames", _BLOCKS + "select ifo, i, y from blocks where i < (select (max(i) - min(i) + 1) // 100 * 100 + min(i) from blocks)")
def replay_frames(v: Views):
    """Whole chunks of 100 blocks only, as a replay from static files gives them."""
    span = F.broadcast(blocks(v).agg((F.expr("(max(i) - min(i) + 1) div 100 * 100 + min(i)")).alias("stop")))
    return live.drain(stream(v).join(span).where("i < stop").select("ifo", "i", "y")).drop("_batch")


@query("gap_reset", _BLOCKS + "select ifo, before + 1 as first, i - before - 1 as missing from lagged where i > before + 1")
def gap_reset(v: Views):
    return walked(v, live.Gaps())


@query("rolling_state", _BLOCKS + """
, runs as (select *, sum(case when i = before + 1 and ready then 0 else 1 end) over (partition by ifo order by i) as run from lagged),
k as (select *, count(*) filter (ready) over (partition by ifo, run order by i rows between 23 preceding and current row) as filled, sum(y) filter (ready) over (partition by ifo, run order by i rows between 23 preceding and current row) as total from runs)
select ifo, i, filled, filled = 24 as full, round(coalesce(total, 0), 4) as total from k
""")
def rolling_state(v: Views):
    return walked(v, stateful.Rolling(24)).select("ifo", "i", "filled", "full", r(col("total"), 4).alias("total"))


@query("stream_boxcar", _BLOCKS + "select ifo, i, round(sum(y) over (partition by ifo order by i rows between 6 preceding and current row) / 7, 6) as y from blocks")
def stream_boxcar(v: Views):
    return walked(v, live.Boxcar(7)).select("ifo", "i", r(col("y")).alias("y"))


@query("dual_rate", _BLOCKS + "select ifo, i, round(sum(y) over (partition by ifo order by i rows between 2 preceding and current row) / 3, 6) as y from lagged where n % 4 = 0")
def dual_rate(v: Views):
    return walked(v, live.Boxcar(3, every=4)).select("ifo", "i", r(col("y")).alias("y"))


@query("all_ready_window", _BLOCKS + "select ifo, i, count(*) over w = 5 and bool_and(ready) over w as usable from blocks window w as (partition by ifo order by i rows between 4 preceding and current row)")
def all_ready_window(v: Views):
    return walked(v, live.AllReady(5))


@query("stream_status", _BLOCKS + ", s as (select ifo, i, ready, coalesce(lag(ready) over (partition by ifo order by i), true) as was from blocks) select ifo, i, ready from s where ready <> was")
def stream_status(v: Views):
    return walked(v, live.Status())


#: The walk over blocks as a recursion; its buffers are lists.
_DETECT = _BLOCKS + """
, b as materialized (select ifo, n, i, y, sig, ready from lagged),
walk as (
  select ifo, -1::bigint as n, -1::bigint as i, []::double[] as ys, []::double[] as ss, 0::bigint as first, false as detecting, -1000000000::bigint as event, null::bigint as hit, null::double as loud, false as partial from (select distinct ifo from b)
  union all
  select ifo, n, i, case when full_ then (case when detecting then ys[-1:] else [] end) else ys end, case when full_ then (case when detecting then ss[-1:] else [] end) else ss end, case when full_ then i else first end, detecting, coalesce(hit, event), hit, loud, partial
  from (
    select ifo, n, i, case when ready then ys else [] end as ys, case when ready then ss else [] end as ss, first, event, len(ys) = {frame} and ready as full_,
      case when not ready then false when len(ys) = {frame} and list_max(ss) >= {threshold} then list_position(ys, list_max(ys)) = {frame} else detecting end as detecting,
      case when not ready then case when detecting and len(ys) > 0 and first + len(ys) - 1 - event >= {period} then first + len(ys) - 1 end
        when len(ys) = {frame} and list_max(ss) >= {threshold} and list_position(ys, list_max(ys)) < {frame} and first + list_position(ys, list_max(ys)) - 1 - event >= {period} then first + list_position(ys, list_max(ys)) - 1 end as hit,
      case when not ready then ss[-1] else list_max(ss) end as loud, not ready as partial
    from (
      select w.ifo, b.n, b.i, b.ready, w.detecting, w.event,
        case when not b.ready then w.ys when len(w.ys) > 0 and b.i = w.first + len(w.ys) then list_append(w.ys, b.y) else [b.y] end as ys,
        case when not b.ready then w.ss when len(w.ys) > 0 and b.i = w.first + len(w.ys) then list_append(w.ss, b.sig) else [b.sig] end as ss,
        case when not b.ready or len(w.ys) > 0 and b.i = w.first + len(w.ys) then w.first else b.i end as first
      from walk w join b on b.ifo = w.ifo and b.n = w.n + 1)
  )
)
select ifo, hit as i, round(loud, 4) as y from walk where hit is not null and partial = {partial}
"""


@query("stream_detect", _DETECT.format(threshold=70.0, frame=3, period=12, partial="false"))
def stream_detect(v: Views):
    """Events timed by the blocks' own scores, as loud as the scores that look back."""
    return walked(v, stateful.Detect(70.0, 3, 12)).where("not partial").select("ifo", "i", r(col("y"), 4).alias("y"))


@query("flush_partial", _DETECT.format(threshold=40.0, frame=2, period=3, partial="true"))
def flush_partial(v: Views):
    return walked(v, stateful.Detect(40.0, 2, 3)).where("partial").select("ifo", "i", r(col("y"), 4).alias("y"))


@query("event_window", _BLOCKS + "select e.ifo, e.i, count(*) as n, round(sum(b.y), 4) as total from blocks e join blocks b on e.ifo = b.ifo and b.i between e.i - 3 and e.i + 1 where e.y > 150 group by e.ifo, e.i")
def event_window(v: Views):
    found = live.drain(live.around(stream(v).where("y > 150"), stream(v), "15 minutes", "5 minutes"))
    return found.groupBy(col("e_ifo").alias("ifo"), col("e_i").alias("i")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("y"), 4).alias("total"))


@query("stream_far", _BLOCKS + "select ifo, i, y, round(greatest((select count(*) from series s where s.slide > 0 and s.y >= b.y and s.y >= 50), 1) / 7776000.0, 12) as far from blocks b where y >= 50")
def stream_far(v: Views):
    return live.drain(live.with_far(stream(v).where("y >= 50"), v.series.where("slide > 0").select(col("y").alias("stat")), "stat", 50.0, 7776000.0)).select("ifo", "i", "y", r(col("far"), 12).alias("far"))


@query("stream_p_astro", _BLOCKS + """
, p as (select user_id % 2 as ifo, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 300000000 as i, avg((value < 20)::int) as low from events where event_type = 'click' group by 1, 2),
e as (select ifo, i, y, case when i % 3 <> 0 then low end as low from blocks left join p using (ifo, i) where y > 60)
select ifo, i, round(y / (y + 50), 8) as p_astro, round(y / (y + 50) * coalesce(low, 0), 8) as bns, round(y / (y + 50) * (1 - coalesce(low, 0)), 8) as bbh from e
""")
def stream_p_astro(v: Views):
    """Events wait ten seconds of event time for their posterior, which comes five or, every third time, twenty seconds later, and then take the default; the streams' ends let go what still waits."""
    block = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 300000000")
    low = v.events.where("event_type = 'click'").groupBy((col("user_id") % 2).alias("ifo"), block.alias("i")).agg(F.avg((col("value") < 20).cast("int")).alias("low"))
    path, schema = folder(v.spark, "posteriors"), "ifo long, i long, low double, p_ts timestamp"
    late = F.when(col("i") % 3 == 0, 20).otherwise(5)
    low.withColumn("p_ts", F.timestamp_seconds(col("i") * 300 + late + 1704067200)).coalesce(2).write.parquet(path)
    live.ending(v.spark, path, schema, "p_ts", datetime(2100, 1, 1))
    found = live.awaited(stream(v, ends=True).where("y > 60 or ifo is null"), live.follow(v.spark, path, schema), ["ifo", "i"], "10 seconds")
    p, low = col("y") / (col("y") + 50), F.coalesce("low", F.lit(0.0))
    return live.drain(found.select("ifo", "i", r(p, 8).alias("p_astro"), r(p * low, 8).alias("bns"), r(p * (1 - low), 8).alias("bbh"))).drop("_batch")


@query("fan_out", _BLOCKS + "select 'alerts' as sink, count(*) as n, round(sum(y), 4) as total from blocks where y > 100 union all select 'archive', count(*), round(sum(y), 4) from blocks")
def fan_out(v: Views):
    path = folder(v.spark, "sinks")

    alerts, archive = live.sink(f"{path}/alerts"), live.sink(f"{path}/archive")

    def each(batch: DataFrame, number: int) -> None:
        alerts(batch.where("y > 100"), number)
        archive(batch, number)

    live.drain(stream(v), each=each)
    sums = lambda k: v.spark.read.schema(_SCHEMA).parquet(f"{path}/{k}").agg(F.lit(k).alias("sink"), F.count(F.lit(1)).alias("n"), r(F.sum("y"), 4).alias("total"))
    return sums("alerts").unionByName(sums("archive")).select("sink", "n", "total")


@query("live_monitor", _BLOCKS + "select ifo, max(i) as i, arg_max(y, i) as y, sum(ready::int) * 300.0::double as live from blocks group by ifo")
def live_monitor(v: Views):
    """The newest block of each detector and its live time so far, refreshed by each micro-batch."""
    path = folder(v.spark, "monitor")
    running = live.monitor(stream(v, files=5, per_batch=1), path, "200 milliseconds", live.upsert(path, "ifo", ["i"], {"live": "if(ready, 300.0D, 0.0D)"}, every=2))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return live.current(v.spark, path, "ifo", ["i"], ["live"]).select("ifo", "i", "y", "live")
