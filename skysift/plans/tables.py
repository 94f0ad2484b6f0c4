"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ledger, logs
from ..sources.store import folder
from .registry import Views, query

_T = "epoch_us(ts) / 1e6"


@query("scan_ledger", "select event_id, user_id, value, null::double as tb from events")
def scan_ledger(v: Views):
    return ledger.read(v.spark, f"{v.sf_dir}/events.parquet", ["event_id", "user_id", "value"], {"tb": "double"})


@query("write_ledger", "select slide, count(*) as n, round(sum(detection_statistic), 4) as total, any_value(7776000.0::double) as tb, (select count(*) from ev) as length from ev group by slide")
def write_ledger(v: Views):
    path = folder(v.spark, "ledger")
    ledger.write(v.ev, path, {"tb": 7776000.0})
    meta = v.spark.read.parquet(f"{path}/metadata")
    rows = v.spark.read.parquet(f"{path}/rows").groupBy("slide").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("detection_statistic"), 4).alias("total"))
    return rows.join(F.broadcast(meta))


@query("scan_injections", "select inj_id, injection_time, slide, snr from inj where injection_time + 6 >= 1704500000 and injection_time - 6 <= 1705500000 and slide in (0, 2)")
def scan_injections(v: Views):
    df = v.inj.withColumn("shift", F.array(F.lit(0.0), F.col("slide").cast("double")))
    return ledger.near(df, 1704500000.0, 1705500000.0, 6.0, [[0, 0], [0, 2]]).drop("shift")


@query("sample_ledger", "select event_id, detection_statistic from ev order by md5(event_id::varchar || '|7'), event_id limit 200")
def sample_ledger(v: Views):
    return ledger.sample(v.ev, 200, "event_id", 7).select("event_id", "detection_statistic")


@query("sample_ledger_replace", """
, n as (select event_id, row_number() over (order by event_id) - 1 as row_id from ev),
d as (select draw, ('0x' || substr(md5(draw::varchar || '|7'), 1, 12))::bigint % (select count(*) from ev) as row_id from range(500) t(draw))
select draw, event_id from d join n using (row_id)
""")
def sample_ledger_replace(v: Views):
    return ledger.sample_with_replacement(v.ev, 500, "event_id", 7).select("draw", "event_id")


@query("union_ledgers", "select event_id::double as event_id, detection_statistic, detection_time from ev where slide in (0, 1, 3)")
def union_ledgers(v: Views):
    cols = ["event_id", "detection_statistic", "detection_time"]
    return ledger.union([v.ev.where(F.col("slide") == s).select(*cols) for s in (0, 1, 3)], cols)


@query("scan_strain", "select block, ifo, len(samples) as n, round(list_sum(list_transform(samples[5:20], lambda x: x::double)), 5) as total from win where block between 20 and 90")
def scan_strain(v: Views):
    total = F.aggregate(F.slice("samples", 5, 16), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.win.where("block between 20 and 90").select("block", "ifo", F.size("samples").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("segments_from_names", """
select name, regexp_extract(name, '(\\d{10}\\.*\\d*)-(\\d+\\.*\\d*)', 1)::double as start,
  regexp_extract(name, '(\\d{10}\\.*\\d*)-(\\d+\\.*\\d*)', 1)::double + regexp_extract(name, '(\\d{10}\\.*\\d*)-(\\d+\\.*\\d*)', 2)::double as stop
from (select case when o_orderkey % 7 = 0 then 'junk-' || o_orderkey else 'background-' || (1000000000 + o_orderkey) || '.5-' || (o_orderkey % 97 + 1) || '.hdf5' end as name from orders)
where regexp_matches(name, '(\\d{10}\\.*\\d*)-(\\d+\\.*\\d*)')
""".replace(".hdf5", ".parquet"))
def segments_from_names(v: Views):
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("junk-"), k)).otherwise(F.concat(F.lit("background-"), k + 1000000000, F.lit(".5-"), k % 97 + 1, F.lit(".parquet")))
    return ledger.names_to_segments(v.table("orders").select(name.alias("name")), "name").where("ok").drop("ok")


@query("sink_events_json", "select event_id, 'H1,L1' as ifos, floor(detection_time)::bigint as end_time, floor((detection_time - floor(detection_time)) * 1e9)::bigint as end_time_ns, event_type from ev where detection_statistic > 150")
def sink_events_json(v: Views):
    rows = v.ev.where("detection_statistic > 150").select("event_id", F.concat_ws(",", F.lit("H1"), F.lit("L1")).alias("ifos"), *ledger.event_record(F.col("detection_time")), "event_type")
    path = folder(v.spark, "json")
    rows.write.partitionBy("event_type").json(path)
    return v.spark.read.schema(rows.schema).json(path)


@query("upsert_events", "select user_id, event_id, detection_statistic from (select *, row_number() over (partition by user_id order by detection_time desc, event_id desc) as r from ev) where r = 1")
def upsert_events(v: Views):
    return ledger.latest(v.ev.select("user_id", "event_id", "detection_statistic", "detection_time"), "user_id", ["detection_time", "event_id"]).drop("detection_time")


@query("store_series", "select slide, count(*) as n, min(i) as first, max(i) as last from series group by slide")
def store_series(v: Views):
    return ledger.series_written(v.series, folder(v.spark, "series"))


@query("segments_io", "select o_orderkey as idx, round(start, 3) as start, round(stop, 3) as stop, round(stop - start, 3) as duration from seg")
def segments_io(v: Views):
    rows = v.seg.select(F.col("o_orderkey").alias("idx"), F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), F.round(F.col("stop") - F.col("start"), 3).alias("duration"))
    return ledger.round_trip(rows, "csv", sep="\t", header="true")


@query("ingest_event_artifacts", """
, e as (select event_id, user_id, detection_time from ev where event_type = 'signup'),
p as (select user_id, round(avg(detection_statistic), 6) as p_astro from ev where event_type = 'click' group by user_id),
q as (select user_id, max(detection_time) as submitted from ev where event_type = 'purchase' group by user_id)
select event_id, user_id, detection_time, p_astro, submitted from e left join p using (user_id) left join q using (user_id)
""")
def ingest_event_artifacts(v: Views):
    path = folder(v.spark, "artifacts")
    v.ev.where("event_type = 'signup'").select("event_id", "user_id", "detection_time").write.json(f"{path}/event")
    v.ev.where("event_type = 'click'").groupBy("user_id").agg(F.round(F.avg("detection_statistic"), 6).alias("p_astro")).write.parquet(f"{path}/p_astro")
    v.ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("detection_time").alias("submitted")).write.csv(f"{path}/latency", header=True)
    e = v.spark.read.schema("event_id long, user_id long, detection_time double").json(f"{path}/event")
    q = v.spark.read.schema("user_id long, submitted double").csv(f"{path}/latency", header=True)
    return e.join(v.spark.read.parquet(f"{path}/p_astro"), "user_id", "left").join(q, "user_id", "left").select("event_id", "user_id", "detection_time", "p_astro", "submitted")


@query("artifact_join", """
, e as (select event_id, user_id from ev where event_type = 'signup'), p as (select user_id, round(avg(detection_statistic), 6) as p_astro from ev where event_type = 'click' group by user_id),
l as (select user_id, round(max(detection_time) - min(detection_time), 3) as latency from ev where event_type = 'purchase' group by user_id), q as (select user_id, count(*) as samples from ev where event_type = 'error' group by user_id)
select event_id, user_id, p_astro, latency, samples from e left join p using (user_id) left join l using (user_id) left join q using (user_id)
""")
def artifact_join(v: Views):
    """Each event with its probability, latency and posterior; what is missing stays null."""
    kind = lambda k: v.ev.where(F.col("event_type") == k)
    p = kind("click").groupBy("user_id").agg(F.round(F.avg("detection_statistic"), 6).alias("p_astro"))
    latency = kind("purchase").groupBy("user_id").agg(F.round(F.max("detection_time") - F.min("detection_time"), 3).alias("latency"))
    q = kind("error").groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))
    return kind("signup").select("event_id", "user_id").join(p, "user_id", "left").join(latency, "user_id", "left").join(q, "user_id", "left").select("event_id", "user_id", "p_astro", "latency", "samples")


@query("scan_logs", "select row_number() over (order by event_type, event_id) - 1 as line, event_type || ' ' || event_id as value from ev")
def scan_logs(v: Views):
    """Logs written before the start are passed over; the others' lines follow each other in the order of the files' names."""
    path = folder(v.spark, "logs")
    lines = v.ev.select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"), "event_type", "event_id").repartition("event_type").sortWithinPartitions("event_type", "event_id")
    v.spark.range(3).select(F.concat(F.lit("old "), F.col("id")).alias("value"), F.lit("aaa").alias("event_type")).write.partitionBy("event_type").text(path)
    start = logs.pause(v.spark, path)
    lines.drop("event_id").write.mode("append").partitionBy("event_type").text(path)
    return logs.scan(v.spark, path, start)


@query("scan_gates", "select round(center, 3) as center, half::double as window, 0.5::double as taper from (select (start + stop) / 2 as center, (stop - start) / 2 as half from veto where category = 'GATES')")
def scan_gates(v: Views):
    rows = v.veto.where("category = 'GATES'").select(F.round((F.col("start") + F.col("stop")) / 2, 3).alias("center"), ((F.col("stop") - F.col("start")) / 2).alias("window"), F.lit(0.5).alias("taper"))
    return ledger.round_trip(rows, "csv", sep=" ")


@query("merge_metadata", "select slide, sum(tb) as tb, sum(n)::bigint as num_injections, min(rate) as rate from (select user_id % 4 as slide, user_id, 100.0::double as tb, count(*) as n, 2048 as rate from events group by user_id) group by slide")
def merge_metadata(v: Views):
    files = v.events.groupBy("slide", "user_id").agg(F.count(F.lit(1)).alias("num_injections")).withColumns({"tb": F.lit(100.0), "rate": F.lit(2048)})
    return ledger.merge_metadata(files, "slide", ["tb", "num_injections"], ["rate"])


@query("append", "select event_id, detection_statistic from ev where slide = 0 union all select event_id, detection_statistic from ev where slide = 1")
def append(v: Views):
    cols = ["event_id", "detection_statistic"]
    return ledger.union([v.ev.where(f"slide = {s}").select(*cols) for s in (0, 1)], ["detection_statistic"])


@query("sample_chunks", """
, f as (select slide, event_id, row_number() over (partition by slide order by event_id) - 1 as row_id, count(*) over (partition by slide) as n from ev),
r as (select draw, ('0x' || substr(md5(draw::varchar || '|file'), 1, 12))::bigint % (select count(*) from ev) as pick, ('0x' || substr(md5(draw::varchar || '|row'), 1, 12))::bigint as h from range(10) t(draw)),
c as (select slide, n, sum(n) over (order by slide) - n as before from (select slide, count(*) as n from ev group by slide)),
k as (select draw, slide, h % greatest(n - 16 + 1, 1) as start from r join c on pick >= before and pick < before + n)
select draw, event_id from k join f using (slide) where row_id >= start and row_id < start + 16
""")
def sample_chunks(v: Views):
    from ..operators.sampling import contiguous_runs

    return contiguous_runs(v.ev.select("slide", "event_id"), "slide", "event_id", draws=10, size=16).select("draw", "event_id")


@query("sample_from_chunk", "select batch, event_id from (select batch, event_id, row_number() over (partition by slide, batch order by md5(event_id::varchar || '|' || batch::varchar), event_id) as r from ev, range(3) t(batch)) where r <= 32")
def sample_from_chunk(v: Views):
    from ..operators.sampling import batches_of_chunk

    return batches_of_chunk(v.ev, "slide", "event_id", batches=3, size=32).select("batch", "event_id")
