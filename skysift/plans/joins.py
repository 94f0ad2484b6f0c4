"""Joins: nearest in time, ranges, intervals, positions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import cosmology, intervals, matching, ranks, strain
from ..sources.store import fixed
from .registry import Views, query

col = F.col


def r(x, n=6):
    return F.round(x, n)


@query("recover_injections", """
select inj_id, event_id, detection_statistic, round(abs(detection_time - injection_time), 6) as dt from (
  select inj_id, event_id, detection_statistic, detection_time, injection_time,
    row_number() over (partition by inj_id order by abs(detection_time - injection_time), detection_time, event_id) as r
  from inj join (select * from ev where event_type = 'click') using (slide)) where r = 1
""")
def recover_injections(v: Views):
    found = v.ev.where("event_type = 'click'").select("slide", "event_id", "detection_statistic", "detection_time")
    got = matching.nearest(v.inj, found, ["slide"], "injection_time", "detection_time", "event_id")
    return got.select("inj_id", "event_id", "detection_statistic", r(F.abs(col("detection_time") - col("injection_time"))).alias("dt"))


@query("apply_vetoes", "select event_id from ev where not exists (select 1 from veto where ifo = 1 and start < detection_time + slide and detection_time + slide < stop)")
def apply_vetoes(v: Views):
    return intervals.veto(v.ev, v.veto.where("ifo = 1"), col("shift")[1], "event_id").select("event_id")


@query("veto_flags", """
select event_id, coalesce(bool_or(category = 'CAT1'), false) as cat1, coalesce(bool_or(category = 'CAT2'), false) as cat2, coalesce(bool_or(category = 'GATES'), false) as gates
from ev left join veto on start < detection_time + case when ifo = 1 then slide else 0 end and detection_time + case when ifo = 1 then slide else 0 end < stop
group by event_id
""")
def veto_flags(v: Views):
    each = v.ev.withColumn("x", F.explode(F.transform("shift", lambda s, i: F.struct(i.cast("long").alias("ifo"), s.alias("s"))))).select("event_id", "detection_time", "x.ifo", "x.s")
    merged = intervals.merge(v.veto, ["ifo", "category"])
    hit = intervals.points_within(each, col("detection_time") + col("s"), merged, 300.0, ["ifo"], ["category"])
    flags = hit.groupBy("event_id").agg(*(F.bool_or(col("category") == k).alias(k.lower()) for k in ("CAT1", "CAT2", "GATES")))
    return v.ev.select("event_id").join(flags, "event_id", "left").na.fill(False)


@query("plan_slides", """
, s as (select o_orderkey, start, stop, k, [0.0::double, k::double] as shifts from seg, range(0, 5) t(k) where (stop - start) - k - 250000 > 0)
select row_number() over (order by start, o_orderkey, k) - 1 as job, o_orderkey, k, shifts from s
""")
def plan_slides(v: Views):
    from ..functions.columns import analyzable

    many = v.seg.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    many = many.withColumn("shifts", F.transform(F.array(F.lit(0.0), F.lit(1.0)), lambda s: s * col("k"))).where(analyzable(col("start"), col("stop"), col("shifts"), 250000.0))
    return ranks.row_ids(many, "start", ("o_orderkey", "k"), name="job").select("job", "o_orderkey", "k", "shifts")


@query("intersect_segments", """
, o as (select flag, start, stop, sum(case when start <= reach then 0 else 1 end) over (partition by flag order by start, stop) as isle
  from (select *, max(stop) over (partition by flag order by start, stop rows between unbounded preceding and 1 preceding) as reach from seg where flag in ('O', 'F'))),
m as (select flag, min(start) as start, max(stop) as stop from o group by flag, isle),
both_ as (select greatest(a.start, b.start) as start, least(a.stop, b.stop) as stop from m a join m b on a.flag = 'O' and b.flag = 'F' and a.start < b.stop and b.start < a.stop),
sp(a, b) as (values (0::double, 788918400::double), (791596800::double, 4e9::double))
select round(greatest(start, a), 6) as start, round(least(stop, b), 6) as stop from both_ join sp on start < b and stop > a where least(stop, b) - greatest(start, a) >= 100
""")
def intersect_segments(v: Views):
    """Times of both flags, in two runs with a month between them that counts for neither."""
    return intervals.intersect(v.seg, "flag", ["O", "F"], 100.0, [(0.0, 788918400.0), (791596800.0, 4e9)]).select(r(col("start")).alias("start"), r(col("stop")).alias("stop"))


@query("flag_partition", "select o_orderkey, flag in ('O', 'P') as open from seg")
def flag_partition(v: Views):
    known = v.spark.range(1).select(F.explode(F.array(F.lit("O"), F.lit("P"))).alias("flag"))
    return v.seg.join(known, "flag", "left_semi").select("o_orderkey", F.lit(True).alias("open")).union(v.seg.join(known, "flag", "left_anti").select("o_orderkey", F.lit(False)))


@query("merge_intervals", """
, o as (select *, max(stop) over (partition by ifo, category order by start, stop rows between unbounded preceding and 1 preceding) as reach from veto),
i as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by ifo, category order by start, stop rows unbounded preceding) as isle from o)
select ifo, category, min(start) as start, max(stop) as stop from i group by ifo, category, isle
""")
def merge_intervals(v: Views):
    return intervals.merge(v.veto, ["ifo", "category"])


@query("files_for_interval", "select inj_id, o_orderkey from (select inj_id, (injection_time - 1704067200) * 80 + 694224000 as t from inj) join seg on start < t + 1 and stop > t - 1")
def files_for_interval(v: Views):
    t = (col("injection_time") - 1704067200) * 80 + 694224000  # over the years of the segments
    asked = v.inj.select("inj_id", (t - 1).alias("r_start"), (t + 1).alias("r_stop"))
    return intervals.overlapping(asked, v.seg, 150000.0).select("inj_id", "o_orderkey")


@query("injections_for_segment", """
, s as (select o_orderkey, start, stop, o_orderkey % 4 as slide from seg)
select o_orderkey, count(inj_id) as n, coalesce(count(inj_id) > 0, false) as foreground
from s left join (select inj_id, slide, (injection_time - 1704067200) * 80 + 694224000 as t from inj) i on s.slide = i.slide and t + 6 > start and t - 6 < stop group by o_orderkey
""")
def injections_for_segment(v: Views):
    s = v.seg.withColumn("slide", col("o_orderkey") % 4)
    t = (col("injection_time") - 1704067200) * 80 + 694224000
    asked = v.inj.select("inj_id", col("slide").alias("own"), (t - 6).alias("r_start"), (t + 6).alias("r_stop"))
    n = intervals.overlapping(asked, s, 150000.0).where("own = slide").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return s.select("o_orderkey").join(n, "o_orderkey", "left").na.fill(0).withColumn("foreground", col("n") > 0)


#: Waveforms: of each injection a block's samples of each detector, scaled; they end ten samples after the injection's time, which spans the strain.
_INJECTED = """
, nb as (select max(block) + 1 as n from win),
sig as (select w.ifo, floor((injection_time - 1704067200) * (n * 64 / 2592000.0::double))::bigint - 54 as first, w.samples as wave, snr from inj, nb join win w on w.block = inj_id % n where snr is not null),
pc as (select ifo, first + k - 1 as i, snr / 100 * wave[k]::double as v from (select *, unnest(range(1, 65)) as k from sig)),
ad as (select ifo, i, sum(v) as v from pc group by 1, 2),
ix as (select block, w.ifo, k - 1 as n, samples[k]::double + coalesce(v, 0) as v from (select *, unnest(range(1, 65)) as k from win) w left join ad on ad.ifo = w.ifo and ad.i = block * 64 + k - 1)
"""


def injected(v: Views):
    """The strain of ``win`` with the injections' waveforms in it."""
    n = v.win.agg(F.max("block")).first()[0] + 1
    at = F.floor((col("injection_time") - 1704067200) * F.lit(n * 64 / 2592000.0)).cast("long") - 54
    waves = v.win.select(col("block").alias("source"), "ifo", "samples")
    signals = v.inj.where("snr is not null").select((col("inj_id") % n).alias("source"), at.alias("first"), "snr").join(waves, "source")
    signals = signals.select("ifo", "first", F.transform("samples", lambda x: col("snr") / 100 * x.cast("double")).alias("wave"))
    strain_rows = v.win.select("block", "ifo", F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    return strain.add_signals(strain_rows, signals, ["ifo"], "block", "samples", 64)


@query("inject_signals", _INJECTED + "select block, ifo, n, round(v, 5) as x from ix")
def inject_signals(v: Views):
    """Waveforms added to the strain where they overlap; one may reach into other blocks, and its ends beyond the strain are cut."""
    return injected(v).select("block", "ifo", F.posexplode("samples").alias("n", "x")).select("block", "ifo", col("n").cast("long").alias("n"), r(col("x"), 5).alias("x"))


@query("align_shifted", """
, x as (select ifo, block * 64 + k - 1 as i, samples[k]::double as v from (select *, unnest(range(1, 65)) as k from win))
select a.i // 64 as block, count(*) as n, round(sum(a.v * b.v), 5) as product from x a join x b on a.ifo = 'H1' and b.ifo = 'L1' and b.i = a.i + 80 group by 1
""")
def align_shifted(v: Views):
    """H1's sample i with L1's sample i + shift, block by block: of L1 the block a whole one on, and of the next the head."""
    there = strain.shifted(v.win.where("ifo = 'L1'"), [], "block", "samples", 80, 64).select("block", col("samples").alias("theirs"))
    both = v.win.where("ifo = 'H1'").join(there, "block")
    product = F.zip_with("samples", "theirs", lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(product, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return both.select("block", F.size(F.filter(product, lambda x: x.isNotNull())).cast("long").alias("n"), r(total, 5).alias("product"))


@query("far_lookup", "select inj_id, (select count(*) from ev where detection_statistic >= snr and slide > 0) as nb from inj")
def far_lookup(v: Views):
    return ranks.counts_at_least(v.ev.where("slide > 0"), v.inj, threshold="snr").select("inj_id", "nb")


@query("zip_batches", """
, a as (select event_id, row_number() over (order by event_id) - 1 as k from ev where slide = 0), b as (select inj_id, row_number() over (order by inj_id) - 1 as k from inj)
select event_id, inj_id, k from a join b using (k)
""")
def zip_batches(v: Views):
    return matching.zipped(v.ev.where("slide = 0").select("event_id"), v.inj.select("inj_id"), "event_id", "inj_id")


@query("pair_signals_windows", """
, a as (select event_id, row_number() over (order by event_id) - 1 as k from ev), b as (select inj_id, row_number() over (order by inj_id) - 1 as k from inj),
s as (select greatest((select count(*) from ev) // (select count(*) from inj), 1) as step)
select event_id, inj_id, b.k from a, s join b on a.k % step = 0 and a.k // step = b.k
""")
def pair_signals_windows(v: Views):
    return matching.strided(v.ev.select("event_id"), v.inj.select("inj_id"), "event_id", "inj_id")


@query("common_span", "select max(a) as start, min(b) as stop from (select flag, min(start) as a, max(stop) as b from seg group by flag)")
def common_span(v: Views):
    return v.seg.groupBy("flag").agg(F.min("start").alias("a"), F.max("stop").alias("b")).agg(F.max("a").alias("start"), F.min("b").alias("stop"))


@query("grid_interp", """
, g as (select s_suppkey::double as gx, s_suppkey * s_suppkey / 10.0 as gy from supplier), q as (select event_id, detection_statistic / 3 as x from ev where detection_statistic is not null)
select event_id, round(case when lo.gx is null then (select gy from g order by gx limit 1) when hi.gx is null then lo.gy else lo.gy + (hi.gy - lo.gy) * (x - lo.gx) / (hi.gx - lo.gx) end, 6) as y
from q asof left join g lo on q.x >= lo.gx left join g hi on hi.gx = coalesce(lo.gx, 0) + 1
""")
def grid_interp(v: Views):
    grid = v.table("supplier").select(col("s_suppkey").cast("double").alias("gx"), (col("s_suppkey") * col("s_suppkey") / 10.0).alias("gy"))
    q = v.ev.select("event_id", (col("detection_statistic") / 3).alias("x"))
    return matching.interpolate(q, "x", grid, "gx", "gy", "y").select("event_id", r(col("y")).alias("y"))


@query("distance_redshift", cosmology.SQL + """
, z as (select distinct redshift as x from camp), d as (select distinct l_quantity * 10 + 0.5 as x from lineitem)
select 'distance' as of_what, round(x, 4) as x, round(distance + (distance1 - distance) * (x / 0.0002 - k), 6) as y from z join cosmos on k = floor(x / 0.0002)
union all select 'redshift', round(x, 4), round(z + (z1 - z) * (x - distance) / (distance1 - distance), 8) from d join cosmos on x >= distance and x < distance1
""")
def distance_redshift(v: Views):
    """Luminosity distances of all redshifts, and redshifts of all distances."""
    there = cosmology.at_redshift(v.camp.select(col("redshift").alias("x")).distinct(), col("x"), "distance", "y")
    back = cosmology.redshift_at(v.table("lineitem").select((col("l_quantity") * 10 + 0.5).alias("x")).distinct(), "x", "y")
    parts = [rows.select(F.lit(name).alias("of_what"), r(col("x"), 4).alias("x"), r(col("y"), n).alias("y")) for rows, name, n in ((there, "distance", 6), (back, "redshift", 8))]
    return parts[0].unionByName(parts[1])


@query("veto_counts", """
, hit as (select distinct event_id, slide > 0 as background, category, ifo from ev join veto on start < detection_time + case when ifo = 1 then slide else 0 end and detection_time + case when ifo = 1 then slide else 0 end < stop),
f as (select *, row_number() over (partition by event_id order by category, ifo) as r from hit)
select category, ifo, background, count(*) as n from f where r = 1 group by category, ifo, background
""")
def veto_counts(v: Views):
    each = v.ev.withColumn("x", F.explode(F.transform("shift", lambda s, i: F.struct(i.cast("long").alias("ifo"), s.alias("s"))))).select("event_id", (col("slide") > 0).alias("background"), "detection_time", "x.ifo", "x.s")
    hit = intervals.points_within(each, col("detection_time") + col("s"), intervals.merge(v.veto, ["ifo", "category"]), 300.0, ["ifo"], ["category"])
    first = hit.groupBy("event_id", "background").agg(F.min(F.struct("category", "ifo")).alias("f"))
    return first.groupBy("f.category", "f.ifo", "background").agg(F.count(F.lit(1)).alias("n"))


@query("event_extent", "select min(detection_time) as start, max(detection_time) as stop from ev where slide > 0")
def event_extent(v: Views):
    return v.ev.where("slide > 0").agg(F.min("detection_time").alias("start"), F.max("detection_time").alias("stop"))


@query("chunk_segments", """
, n as (select o_orderkey, start, stop, unnest(range(0, greatest(ceil((stop - start) / 20000), 1)::bigint)) as piece from seg)
select o_orderkey, piece, round(start + piece * 20000, 6) as start, round(least(stop, start + piece * 20000 + 20000), 6) as stop from n
""")
def chunk_segments(v: Views):
    return intervals.chunked(v.seg, 20000.0).select("o_orderkey", "piece", r(col("start")).alias("start"), r(col("stop")).alias("stop"))
