"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.ranks import row_ids
from .registry import Views, query

col = F.col


def r(x, n=6):
    return F.round(x, n)


@query("slice_rows", ", n as (select event_id, detection_statistic, row_number() over (order by detection_time, event_id) - 1 as row_id from ev) select * from n where row_id between 100 and 499")
def slice_rows(v: Views):
    return row_ids(v.ev, "detection_time", ("event_id",)).where("row_id between 100 and 499").select("event_id", "detection_statistic", "row_id")


@query("get_shift", "select event_id, detection_statistic from ev where shift = [0.0::double, 1.0::double]")
def get_shift(v: Views):
    return v.ev.where(col("shift") == F.array(F.lit(0.0), F.lit(1.0))).select("event_id", "detection_statistic")


@query("get_times", "select inj_id, injection_time from inj where injection_time >= 1704500000 and injection_time < 1705500000")
def get_times(v: Views):
    return v.inj.where((col("injection_time") >= 1704500000) & (col("injection_time") < 1705500000)).select("inj_id", "injection_time")


_CHIRP = "pow(pow(mass_1 * mass_2, 3) / (mass_1 + mass_2), 0.2)"


@query("mass_params", f"""
, m as (select mass_1, mass_2, {_CHIRP} as chirp, mass_1 + mass_2 as total, mass_2 / mass_1 as q, count(*) as n from camp group by all)
select round(mass_1, 6) as mass_1, round(chirp, 6) as chirp_mass, round(total, 6) as total_mass, round(q, 6) as mass_ratio,
  round(chirp * pow(1 + q, 0.2) / pow(q, 0.6), 4) as back_1, round(chirp * pow(1 + q, 0.2) / pow(q, 0.6) * q, 4) as back_2, n from m
""")
def mass_params(v: Views):
    m = v.camp.groupBy("mass_1", "mass_2").agg(F.count(F.lit(1)).alias("n")).withColumns({"chirp": c.chirp_mass(col("mass_1"), col("mass_2")), "q": col("mass_2") / col("mass_1")})
    a, b = c.component_masses(col("chirp"), col("q"))
    return m.select(r(col("mass_1")).alias("mass_1"), r(col("chirp")).alias("chirp_mass"), r(col("mass_1") + col("mass_2")).alias("total_mass"), r(col("q")).alias("mass_ratio"), r(a, 4).alias("back_1"), r(b, 4).alias("back_2"), "n")


@query("frame_masses", "select redshift, round(sum(mass_1 / (1 + redshift)), 3) as source, round(sum(mass_1 * (1 + redshift)), 3) as detector from camp group by redshift")
def frame_masses(v: Views):
    z, m = col("redshift"), col("mass_1")
    return v.camp.groupBy("redshift").agg(r(F.sum(c.source_frame(m, z)), 3).alias("source"), r(F.sum(c.detector_frame(m, z)), 3).alias("detector"))


@query("split_ifo_snr", "select vec_id, round(embedding[1]::double, 6) as h1_snr, round(embedding[2]::double, 6) as l1_snr, round(sqrt(embedding[1]::double * embedding[1]::double + embedding[2]::double * embedding[2]::double), 6) as snr from embeddings")
def split_ifo_snr(v: Views):
    x = F.transform(F.slice("embedding", 1, 2), lambda s: s.cast("double"))
    return v.table("embeddings").select("vec_id", r(x[0]).alias("h1_snr"), r(x[1]).alias("l1_snr"), r(c.network(x)).alias("snr"))


@query("drop_unphysical", "select slide, count(*) filter (snr <= 100) as kept, count(*) filter (snr > 100) as dropped, count(*) filter (snr >= 100) as dropped_by_viewer from inj group by slide")
def drop_unphysical(v: Views):
    return v.inj.groupBy("slide").agg(F.count_if(col("snr") <= 100).alias("kept"), F.count_if(col("snr") > 100).alias("dropped"), F.count_if(col("snr") >= 100).alias("dropped_by_viewer"))


@query("range_filter", "select count(*) as n, round(sum(detection_statistic), 2) as total from camp where mass_1 between 10 and 50 and redshift between 0.02 and 0.05")
def range_filter(v: Views):
    return v.camp.where(c.in_ranges({"mass_1": (10, 50), "redshift": (0.02, 0.05)})).agg(F.count(F.lit(1)).alias("n"), r(F.sum("detection_statistic"), 2).alias("total"))


@query("analyzable", "select o_orderkey, (stop - start) - 3 - 64 > 0 as ok from seg")
def analyzable(v: Views):
    return v.seg.select("o_orderkey", c.analyzable(col("start"), col("stop"), F.array(F.lit(0.0), F.lit(3.0)), 64.0).alias("ok"))


@query("hours_since_first", "select event_id, round((detection_time - (select min(detection_time) from ev)) / 3600 + slide, 6) as hours from ev")
def hours_since_first(v: Views):
    first = F.broadcast(v.ev.agg(F.min("detection_time").alias("first")))
    total = F.aggregate("shift", F.lit(0.0), lambda a, x: a + x)
    return v.ev.join(first).select("event_id", r((col("detection_time") - col("first")) / 3600 + total).alias("hours"))


@query("ready_bits", "select vec_id, list_bool_and(list_transform(embedding, lambda x: (floor(x::double * 100 + 100)::bigint & 3) = 3)) as ready, len(list_filter(embedding, lambda x: (floor(x::double * 100 + 100)::bigint & 3) = 3)) as n_ready from embeddings")
def ready_bits(v: Views):
    state = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 100))
    return v.table("embeddings").select("vec_id", c.ready(state).alias("ready"), F.size(F.filter(state, lambda x: x.bitwiseAND(3) == 3)).cast("long").alias("n_ready"))


@query("prior_range_filter", "select count(*) filter (mass_1 between 10 and 90 and redshift between 0 and 0.08) as kept, count(*) filter (not mass_1 between 10 and 90) as mass_1_out, count(*) filter (not redshift between 0 and 0.08) as redshift_out from camp")
def prior_range_filter(v: Views):
    ranges = {"mass_1": (10.0, 90.0), "redshift": (0.0, 0.08)}
    return v.camp.agg(F.count_if(c.in_ranges(ranges)).alias("kept"), *(F.count_if(~col(k).between(*x)).alias(f"{k}_out") for k, x in ranges.items()))


@query("posterior_derive", f"select ifo, round(sum(((redshift * 100 + 1.5) % (2 * pi()))), 3) as ra, round(sum({_CHIRP} / (1 + redshift)), 3) as chirp_mass_source from camp group by ifo")
def posterior_derive(v: Views):
    ra = F.pmod(col("redshift") * 100 + 1.5, F.lit(2 * 3.141592653589793))
    return v.camp.groupBy("ifo").agg(r(F.sum(ra), 3).alias("ra"), r(F.sum(c.source_frame(c.chirp_mass(col("mass_1"), col("mass_2")), col("redshift"))), 3).alias("chirp_mass_source"))


@query("latency_columns", """
, p as (select event_id, detection_time as gps, case when event_id % 3 = 0 then null else detection_time + event_id % 7 end as written, detection_time + 10 + event_id % 11 as submitted from ev)
select event_id, round(submitted - gps, 6) as total, round(coalesce(written, floor(gps)) - gps, 6) as write, round(submitted - coalesce(written, floor(gps)), 6) as pipeline from p
""")
def latency_columns(v: Views):
    gps, k = col("detection_time"), col("event_id")
    sent, written = gps + 10 + k % 11, F.coalesce(F.when(k % 3 != 0, gps + k % 7), F.floor(gps).cast("double"))
    return v.ev.select("event_id", r(sent - gps).alias("total"), r(written - gps).alias("write"), r(sent - written).alias("pipeline"))


@query("dt_gate", "select inj_id, case when abs(injection_time % 100 - 50) > 25 then 0 else snr end as weight from inj")
def dt_gate(v: Views):
    return v.inj.select("inj_id", F.when(F.abs(col("injection_time") % 100 - 50) > 25, 0.0).otherwise(col("snr")).alias("weight"))


@query("param_transform", "select event_id, round(ln(detection_statistic + 1), 6) as detection_statistic, round(sqrt(detection_time), 6) as detection_time from ev")
def param_transform(v: Views):
    how = {"detection_statistic": lambda x: F.log(x + 1), "detection_time": F.sqrt}
    return v.ev.withColumns({k: r(f(col(k))) for k, f in how.items()}).select("event_id", *how)


@query("gate_to_veto", "select round(x - w - 0.875, 6) as start, round(x + w + 0.875, 6) as stop from (select (start + stop) / 2 as x, (stop - start) / 2 as w from veto where category = 'GATES')")
def gate_to_veto(v: Views):
    a, b = c.gate((col("start") + col("stop")) / 2, (col("stop") - col("start")) / 2, F.lit(0.5))
    return v.veto.where("category = 'GATES'").select(r(a).alias("start"), r(b).alias("stop"))


@query("catalog_to_veto", "select inj_id, injection_time - 1 as start, injection_time + 1 as stop from inj")
def catalog_to_veto(v: Views):
    return v.inj.select("inj_id", (col("injection_time") - 1).alias("start"), (col("injection_time") + 1).alias("stop"))


@query("log_statement_time", "select event_id, epoch_us(date_trunc('milliseconds', ts)) as t from events")
def log_statement_time(v: Views):
    line = F.concat(F.translate(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), ".", ","), F.lit(" INFO event"))
    return v.events.where(line.startswith("202")).select("event_id", F.unix_micros(c.statement_time(line)).alias("t"))


@query("parse_frame_name", "select o_orderkey, 'K-H1_llhoft' as prefix, (1000000000 + o_orderkey)::double as start, (o_orderkey % 9 + 1)::double as duration from orders")
def parse_frame_name(v: Views):
    k = col("o_orderkey")
    name = F.concat(F.lit("K-H1_llhoft-"), k + 1000000000, F.lit("-"), k % 9 + 1, F.lit(".gwf"))
    return v.table("orders").select("o_orderkey", *c.frame_name(name))


@query("ceil_div", "select o_orderkey, floor((o_orderkey - 1) / (o_orderkey % 13 + 1.0))::bigint + 1 as n from orders")
def ceil_div(v: Views):
    return v.table("orders").select("o_orderkey", c.ceil_div(col("o_orderkey"), col("o_orderkey") % 13 + 1).alias("n"))


_ERF = "(case when {x} >= 0 then 1 else -1 end * (1 - (1 / (1 + 0.3275911 * abs({x})) * (0.254829592 + 1 / (1 + 0.3275911 * abs({x})) * (-0.284496736 + 1 / (1 + 0.3275911 * abs({x})) * (1.421413741 + 1 / (1 + 0.3275911 * abs({x})) * (-1.453152027 + 1 / (1 + 0.3275911 * abs({x})) * 1.061405429))))) * exp(-{x} * {x})))"
_LN = "exp(-0.5 * pow((ln(mass_2) - 3) / 0.5, 2)) / (mass_2 * 0.5 * sqrt(2 * pi()))"


@query("posterior_weight_pdf", f"""
, m as (select distinct mass_1, mass_2 from camp)
select round(mass_1, 6) as mass_1, round(mass_2, 6) as mass_2,
  round(case when mass_1 between 5 and 100 then pow(mass_1, -2.35) * (-1.35) / (pow(100, -1.35) - pow(5, -1.35)) else 0 end, 8) as p_power,
  round(case when mass_2 >= 1 and mass_2 <= mass_1 then mass_2 * 2 / (pow(mass_1, 2) - 1) else 0 end, 8) as p_conditional,
  round({_LN}, 8) as p_normal,
  round(case when mass_2 <= mass_1 then {_LN} / (0.5 * (1 + {_ERF.format(x='((ln(mass_1) - 3) / 0.5 / sqrt(2.0))')})) else 0 end, 8) as p_truncated
from m
""")
def posterior_weight_pdf(v: Views):
    m1, m2 = col("mass_1"), col("mass_2")
    return v.camp.select("mass_1", "mass_2").distinct().select(
        r(m1).alias("mass_1"), r(m2).alias("mass_2"), r(c.power_law(m1, -2.35, 5, 100), 8).alias("p_power"), r(c.conditional_power_law(m2, 1.0, 1, m1), 8).alias("p_conditional"),
        r(c.log_normal(m2, 3, 0.5), 8).alias("p_normal"), r(c.truncated_log_normal(m2, 3, 0.5, m1), 8).alias("p_truncated"),
    )


@query("mass_order", "select count(*) as n, round(sum(mass_1), 2) as total from camp where mass_1 > mass_2")
def mass_order(v: Views):
    return v.camp.where("mass_1 > mass_2").agg(F.count(F.lit(1)).alias("n"), r(F.sum("mass_1"), 2).alias("total"))


@query("aligned_spins", "select vec_id, 0.0::double as spin1x, 0.0::double as spin1y, embedding[1]::double as spin1z, embedding[2]::double as spin2z from embeddings")
def aligned_spins(v: Views):
    return v.table("embeddings").select("vec_id", F.lit(0.0).alias("spin1x"), F.lit(0.0).alias("spin1y"), col("embedding")[0].cast("double").alias("spin1z"), col("embedding")[1].cast("double").alias("spin2z"))


@query("sort_by", "select slide, count(*) filter (detection_statistic < previous) as descents from (select slide, detection_statistic, lag(detection_statistic) over (partition by slide order by detection_time, event_id) as previous from ev) group by slide")
def sort_by(v: Views):
    from pyspark.sql import Window

    before = F.lag("detection_statistic").over(Window.partitionBy("slide").orderBy("detection_time", "event_id"))
    return v.ev.withColumn("previous", before).groupBy("slide").agg(F.count_if(col("detection_statistic") < col("previous")).alias("descents"))


@query("is_sorted_by", "select slide, count(*) filter (detection_time < previous) = 0 as by_time, count(*) filter (detection_statistic < before) = 0 as by_statistic from (select slide, detection_time, detection_statistic, lag(detection_time) over w as previous, lag(detection_statistic) over w as before from ev window w as (partition by slide order by detection_time, event_id)) group by slide")
def is_sorted_by(v: Views):
    from pyspark.sql import Window

    w = Window.partitionBy("slide").orderBy("detection_time", "event_id")
    down = lambda c: col(c) < F.lag(c).over(w)
    rows = v.ev.select("slide", down("detection_time").alias("t"), down("detection_statistic").alias("s"))
    return rows.groupBy("slide").agg((F.count_if("t") == 0).alias("by_time"), (F.count_if("s") == 0).alias("by_statistic"))


@query("loudest", "select event_id, detection_statistic from ev order by detection_statistic desc, event_id limit 50")
def loudest(v: Views):
    return v.ev.orderBy(F.desc("detection_statistic"), "event_id").limit(50).select("event_id", "detection_statistic")


@query("limit_rows", "select event_id, detection_time from ev order by detection_time, event_id limit 25")
def limit_rows(v: Views):
    return v.ev.orderBy("detection_time", "event_id").limit(25).select("event_id", "detection_time")


@query("split_zero_lag", "select event_id, case when slide = 0 then 'zero-lag' else 'background' end as part from ev")
def split_zero_lag(v: Views):
    zero = F.forall("shift", lambda s: s == 0)
    return v.ev.where(zero).select("event_id", F.lit("zero-lag").alias("part")).unionByName(v.ev.where(~zero).select("event_id", F.lit("background").alias("part")))


@query("except_files", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
def except_files(v: Views):
    valid = v.table("customer").where("c_nationkey = 3").select(col("c_custkey").alias("o_custkey"))
    return v.table("orders").join(valid, "o_custkey", "left_anti").select("o_orderkey")


@query("time_axis", "select block, ifo, k, round(block * 10.0 + (k - 1) / 16.0, 6) as t from (select block, ifo, unnest(range(1, len(samples) + 1)) as k from win)")
def time_axis(v: Views):
    axis = F.transform(F.sequence(F.lit(1), F.size("samples")), lambda k: F.struct(k.cast("long").alias("k"), r(col("block") * 10.0 + (k - 1) / 16.0).alias("t")))
    return v.win.select("block", "ifo", F.explode(axis).alias("x")).select("block", "ifo", "x.k", "x.t")


@query("check_ledger", "select count(*) filter (stop - start < 1000) as short, count(*) filter (start is null) as no_start, count(*) filter (stop <= start) as empty from seg")
def check_ledger(v: Views):
    return v.seg.agg(F.count_if(col("stop") - col("start") < 1000).alias("short"), F.count_if(col("start").isNull()).alias("no_start"), F.count_if(col("stop") <= col("start")).alias("empty"))
