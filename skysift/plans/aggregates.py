"""Rates, significance, livetime, sensitivity, densities, monitoring numbers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import columns as c
from ..operators import cosmology, ranks, sensitivity, series
from .registry import Views, query

col = F.col
YEAR = c.YEAR_FAR


def r(x, n=6):
    return F.round(x, n)


_NB = ", n as (select inj_id, snr, (select count(*) from ev where detection_statistic >= snr and slide > 0) as nb from inj)"
_TB = 3 * 30 * 86400.0


def _nb(v: Views):
    return ranks.counts_at_least(v.ev.where("slide > 0"), v.inj.select("inj_id", "snr"), threshold="snr")


@query("nb", _NB + " select * from n")
def nb(v: Views):
    return _nb(v)


@query("far", _NB + f" select inj_id, round(greatest({YEAR} * nb / {_TB}, {YEAR} / {_TB}), 6) as far, round({YEAR} / {_TB}, 6) as min_far from n")
def far(v: Views):
    return _nb(v).select("inj_id", r(sensitivity.far(col("nb"), F.lit(_TB))).alias("far"), r(F.lit(YEAR / _TB)).alias("min_far"))


@query("min_far", f"select slide, round({YEAR} / tb, 8) as min_far from tb")
def min_far(v: Views):
    return v.tb.select("slide", r(sensitivity.far(F.lit(0), col("tb")), 8).alias("min_far"))


@query("significance", _NB + f" select inj_id, round(1 - exp(-86400.0 * (1 + nb) / {_TB}), 8) as significance from n")
def significance(v: Views):
    return _nb(v).select("inj_id", r(sensitivity.significance(col("nb"), F.lit(_TB), 86400.0), 8).alias("significance"))


@query("threshold_at_far", "select max(detection_statistic) as threshold from (select detection_statistic, row_number() over (order by detection_statistic desc) as r from ev where detection_statistic is not null) where r = 77")
def threshold_at_far(v: Views):
    return ranks.kth_largest(v.ev, "detection_statistic", int(_TB * 1e-5))


@query("livetime", "select slide = 0 as zero_lag, sum(tb)::double as tb from (select slide, count(*) filter (i >= 12) / 4.0 as tb from series group by slide) group by 1")
def livetime(v: Views):
    each = v.series.where("i >= 12").groupBy("slide").agg((F.count(F.lit(1)) / 4.0).alias("tb"))
    return each.groupBy((col("slide") == 0).alias("zero_lag")).agg(F.sum("tb").alias("tb"))


@query("num_shifts_for_Tb", """
, k as (select k, sum(greatest(stop - start - 64 - k * 1000, 0)) as tb from (select *, unnest(range(1, greatest(ceil((stop - start) / 1000), 1)::bigint + 1)) as k from seg) group by k),
s as (select k, sum(tb) over (order by k) as total from k)
select min(k) as shifts from s where total >= 10000000000
""")
def num_shifts_for_tb(v: Views):
    return sensitivity.shifts_for_livetime(v.seg, 10000000000.0, 1000.0, 64.0)


@query("num_shifts_for_signals", """
, t as (select sum(stop - start) as t from seg)
select ceil((-(t - 2 * 12 - 0.5) + sqrt((t - 2 * 12 - 0.5) * (t - 2 * 12 - 0.5) - 2 * 1.0 * 1000000 * 24)) / -1.0)::bigint as shifts from t
""")
def num_shifts_for_signals(v: Views):
    return sensitivity.shifts_for_signals(v.seg, spacing=16.0, shift=1.0, buffer=8.0, duration=8.0, n=1000000)


_W = """
, w0 as (select detection_statistic as s, recovered, case when mass_1 between 5 and 100 then pow(mass_1, -2.35) else 0 end / (1 + redshift) as w from camp),
w as (select s, recovered, w / (select sum(w) from w0) as w from w0)
"""


def _weights(v: Views):
    w = F.when(col("mass_1").between(5, 100), F.pow("mass_1", F.lit(-2.35))).otherwise(0.0) / (1 + col("redshift"))
    return sensitivity.importance(v.camp.withColumn("w", w), "w")


@query("importance_weights", _W + " select recovered, count(*) as n, round(sum(w), 8) as total, round(sum(w * w), 10) as squares from w group by recovered")
def importance_weights(v: Views):
    return _weights(v).groupBy("recovered").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w"), 8).alias("total"), r(F.sum(col("w") * col("w")), 10).alias("squares"))


#: Pairs of masses that volumes are told for.
PAIRS = [(35.0, 35.0), (35.0, 20.0), (20.0, 20.0), (20.0, 10.0)]
_PAIR_SQL = """
, pw as (select * from (values {pairs}) t(name, a, b)),
pw0 as (select name, detection_statistic as s, recovered, exp(-(pow(ln(mass_1 / a), 2) + pow(ln(mass_2 / b), 2)) / 0.5) / (1 + redshift) as w from camp, pw),
pwn as (select name, s, recovered, w / sum(w) over (partition by name) as w from pw0),
pvol as (select name, threshold, coalesce(sum(w) filter (s >= threshold), 0) as mu, coalesce(sum(w * w) filter (s >= threshold), 0) as s2, sum(w * w) as a2 from pwn, (select k * 10.0::double as threshold from range(0, 11) t(k)) where recovered group by name, threshold),
pair_volumes as (select name, threshold, mu * 1000 as volume, sqrt(greatest((1 - 2 * mu) * s2 + mu * mu * a2, 0)) * 1000 as sigma from pvol)
""".format(pairs=", ".join(f"('{a:g}-{b:g}', {a}::double, {b}::double)" for a, b in PAIRS))


def pair_volumes(v: Views):
    """Volumes per pair of masses and threshold; weights lie log-normally about the pair and sum to 1 over all injections."""
    names = {f"{a:g}-{b:g}": f"w{i}" for i, (a, b) in enumerate(PAIRS)}
    near = [F.exp(-(F.pow(F.log(col("mass_1") / a), F.lit(2)) + F.pow(F.log(col("mass_2") / b), F.lit(2))) / 0.5) / (1 + col("redshift")) for a, b in PAIRS]
    rows = v.camp.select("detection_statistic", "recovered", *(x.alias(n) for x, n in zip(near, names.values())))
    total = F.broadcast(rows.agg(*(F.sum(n).alias(f"all_{n}") for n in names.values())))
    rows = rows.join(total).where("recovered").select("detection_statistic", *((col(n) / col(f"all_{n}")).alias(n) for n in names.values()))
    thresholds = v.spark.range(11).select((col("id") * 10.0).alias("threshold"))
    return sensitivity.volume(rows, thresholds, "detection_statistic", names, 1000.0)


@query("sensitive_volume", _PAIR_SQL + " select name, threshold, round(volume, 6) as volume, round(sigma, 6) as sigma from pair_volumes")
def sensitive_volume(v: Views):
    return pair_volumes(v).select("name", "threshold", r(col("volume")).alias("volume"), r(col("sigma")).alias("sigma"))


#: Volume times time that four searches published per pair of masses, over 149.3747 days.
PUBLISHED_DAYS = 149.3747
PUBLISHED = [
    ("GstLAL", "35-35", 4.1), ("GstLAL", "35-20", 2.3), ("GstLAL", "20-20", 1.34), ("GstLAL", "20-10", 0.6), ("GstLAL", "1.5-1.5", 2.7e-3),
    ("PyCBC-BBH", "35-35", 4.3), ("PyCBC-BBH", "35-20", 2.5), ("PyCBC-BBH", "20-20", 1.42), ("PyCBC-BBH", "20-10", 0.65), ("PyCBC-BBH", "1.5-1.5", 0.0),
    ("cWB", "35-35", 2.6), ("cWB", "35-20", 1.35), ("cWB", "20-20", 0.56), ("cWB", "20-10", 0.24), ("cWB", "1.5-1.5", 0.0),
    ("MBTA", "35-35", 3.3), ("MBTA", "35-20", 1.8), ("MBTA", "20-20", 1.1), ("MBTA", "20-10", 0.51), ("MBTA", "1.5-1.5", 3.4e-3),
]


@query("compare_catalog", _PAIR_SQL + f"""
, pub as (select * from (values {", ".join(f"('{p}', '{m}', {x!r}::double)" for p, m, x in PUBLISHED)}) t(search, name, vt))
select search, name, threshold, round(vt * 365 / {PUBLISHED_DAYS}, 6) as published, round(volume, 6) as volume, round(volume / (vt * 365 / {PUBLISHED_DAYS}), 6) as ratio from pub join pair_volumes using (name)
""")
def compare_catalog(v: Views):
    """Published volumes of other searches beside those of this campaign, per pair of masses and threshold."""
    pub = v.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("search"), F.lit(m).alias("name"), F.lit(x).alias("vt")) for p, m, x in PUBLISHED))))
    rows = pair_volumes(v).join(F.broadcast(pub), "name").withColumn("published", col("vt") * 365 / PUBLISHED_DAYS)
    return rows.select("search", "name", "threshold", r(col("published")).alias("published"), r(col("volume")).alias("volume"), r(col("volume") / col("published")).alias("ratio"))


@query("far_threshold_grid", f"select detection_statistic as threshold, row_number() over (order by detection_statistic desc) as k, round(row_number() over (order by detection_statistic desc) / {_TB}, 12) as far from ev where slide > 0 order by detection_statistic desc limit 77")
def far_threshold_grid(v: Views):
    return sensitivity.threshold_grid(v.ev.where("slide > 0"), "detection_statistic", 1e-5, _TB).select("threshold", "k", r(col("far"), 12).alias("far"))


_D = "(-2.35 * ln(mass_1) - 0.5 * ln(mass_2 + 1) - ln(1 + redshift))"


@query("population_vt", f"""
, d as (select detection_statistic as s, {_D} as x from camp where recovered), m as (select max(x) as m from d)
select threshold, round(ln(10.0) - ln((select count(*) from camp)) + m + ln(sum(exp(x - m))), 8) as log_vt, round(ln(10.0) - ln((select count(*) from camp)) + m + ln(sum(exp(2 * (x - m))) - pow(sum(exp(x - m)), 2) / (select count(*) from camp)) / 2, 8) as log_sigma,
  round(pow(sum(exp(x - m)), 2) / (sum(exp(2 * (x - m))) - pow(sum(exp(x - m)), 2) / (select count(*) from camp)), 4) as n_eff
from d, m, (select k * 20.0::double as threshold from range(0, 5) t(k)) where s >= threshold group by threshold, m
""")
def population_vt(v: Views):
    x = -2.35 * F.log("mass_1") - 0.5 * F.log(col("mass_2") + 1) - F.log(1 + col("redshift"))
    thresholds = v.spark.range(5).select((col("id") * 20.0).alias("threshold"))
    out = sensitivity.log_vt(v.camp.where("recovered").withColumn("x", x), thresholds, "detection_statistic", "x", 10.0, v.camp.count())
    return out.select("threshold", r(col("log_vt"), 8).alias("log_vt"), r(col("log_sigma"), 8).alias("log_sigma"), r(col("n_eff"), 4).alias("n_eff"))


@query("population_density", cosmology.SQL + """
, m as (select distinct mass_1, mass_2, redshift from camp where mass_1 > mass_2),
z as (select m.*, rate + (rate1 - rate) * (redshift / 0.0002 - k) as rate, (select max(volume) from cosmos) as volume from m join cosmos on k = floor(redshift / 0.0002))
select round(mass_1, 4) as mass_1, round(mass_2, 4) as mass_2, round(redshift, 4) as redshift,
  round(-2.35 * ln(mass_1) + ln(mass_2) - ln(mass_1 * mass_1) - ln(4 * pi()) - ln(case when mass_1 < 20 then 0.4 else 0.99 end) - ln(0.04) + case when rate > 0 then ln(rate / volume) end, 6) as log_density from z
""")
def population_density(v: Views):
    """Log density in masses, spins and redshift: in redshift that of comoving volume, time dilated, of which there is none at 0."""
    m = v.camp.where("mass_1 > mass_2").select("mass_1", "mass_2", "redshift").distinct()
    mass = -2.35 * F.log("mass_1") + F.log("mass_2") - F.log(col("mass_1") * col("mass_1"))
    m = cosmology.at_redshift(m, col("redshift"), "rate", "_rate").join(F.broadcast(cosmology.grid(v.spark).agg(F.max("volume").alias("_all"))))
    far = F.when(col("_rate") > 0, F.log(col("_rate") / col("_all")))
    density = mass + sensitivity.log_spin_density(F.lit(0.2), F.when(col("mass_1") < 20, 0.4).otherwise(0.99)) + far
    return m.select(r(col("mass_1"), 4).alias("mass_1"), r(col("mass_2"), 4).alias("mass_2"), r(col("redshift"), 4).alias("redshift"), r(density).alias("log_density"))


@query("astro_volume", cosmology.SQL + """
, b as (select distinct l_discount as z, l_tax * 10 as band from lineitem)
select round(b.z, 4) as z, round(band, 4) as band, round((volume + (volume1 - volume) * (b.z / 0.0002 - k)) * 2 * pi() * (sin(band) - sin(-band)) / 1e9, 8) as volume from b join cosmos on k = floor(b.z / 0.0002)
""")
def astro_volume(v: Views):
    """Volume in cubic Gpc up to each redshift of the table, within each of its bands about the equator."""
    b = v.table("lineitem").select(col("l_discount").alias("z"), (col("l_tax") * 10).alias("band")).distinct()
    out = cosmology.volume_between(b, F.lit(0.0), col("z"), -col("band"), col("band"), "volume")
    return out.select(r(col("z"), 4).alias("z"), r(col("band"), 4).alias("band"), r(col("volume") / 1e9, 8).alias("volume"))


@query("injected_volume", cosmology.SQL + """
, e as (select min(l_discount) + 0.01 as z0, max(l_discount) as z1, min(l_tax) - 0.04 as d0, max(l_tax) - 0.04 as d1 from lineitem),
c as (select a.volume + (a.volume1 - a.volume) * (e.z0 / 0.0002 - a.k) as v0, b.volume + (b.volume1 - b.volume) * (e.z1 / 0.0002 - b.k) as v1, d0, d1 from e join cosmos a on a.k = floor(e.z0 / 0.0002) join cosmos b on b.k = floor(e.z1 / 0.0002))
select round((v1 - v0) * 2 * pi() * (sin(d1) - sin(d0)) / 1e9, 10) as volume from c
""")
def injected_volume(v: Views):
    """Volume in cubic Gpc that the recovered and rejected injections span."""
    return _injected(v).select(r(col("volume") / 1e9, 10).alias("volume"))


def _injected(v: Views):
    rows = v.table("lineitem").select(col("l_discount").alias("redshift"), (col("l_tax") - 0.04).alias("dec"))
    e = rows.agg((F.min("redshift") + 0.01).alias("z0"), F.max("redshift").alias("z1"), F.min("dec").alias("d0"), F.max("dec").alias("d1"))
    return cosmology.volume_between(e, col("z0"), col("z1"), col("d0"), col("d1"), "volume")


_KDE = """
, x as (select snr as x from inj), h as (select stddev_samp(x) * pow(count(*), -0.2) as h, count(*) as n from x), g as (select k * 5.0::double as pt from range(0, 41) t(k)),
f as (select pt, sum(exp(-pow((pt - x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) as pdf from g, x, h group by pt)
"""


def _grid(v: Views):
    return v.spark.range(41).select((col("id") * 5.0).alias("pt"))


@query("kde_density", _KDE + "select round(pt, 3) as pt, round(pdf * 2.5, 10) as rate from f")
def kde_density(v: Views):
    return sensitivity.kde(v.inj, "snr", _grid(v), "pt").select(r(col("pt"), 3).alias("pt"), r(col("pdf") * 2.5, 10).alias("rate"))


_POLY = _KDE + """
, p as (select arg_max(pt, pdf) as peak from f), t as (select 1 / sqrt(count(*)) * 0.02 as thr from x),
s as (select min(pt) filter (pt > peak and pdf <= 10 * thr) as start, min(pt) filter (pt > peak and pdf <= thr) as stop from f, p, t),
l as (select regr_slope(ln(pdf), pt) as slope, regr_intercept(ln(pdf), pt) as intercept from f, s where pt >= start and pt < stop)
"""


@query("kde_poly_background", _POLY + "select round(pt, 3) as pt, round(case when pt >= stop then exp(intercept + slope * pt) else pdf end, 10) as pdf from f, s, l")
def kde_poly_background(v: Views):
    n = v.inj.count()
    return sensitivity.kde_with_tail(sensitivity.kde(v.inj, "snr", _grid(v), "pt"), "pt", 0.02 / n**0.5).select(r(col("pt"), 3).alias("pt"), r(col("pdf"), 10).alias("pdf"))


@query("p_astro", cosmology.SQL + _KDE + f"""
, bx as (select detection_statistic as x from ev where slide > 0 and detection_statistic is not null), bh as (select stddev_samp(x) * pow(count(*), -0.2) as h, count(*) as n from bx),
b0 as (select pt, sum(exp(-pow((pt - x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) as pdf from g, bx, bh group by pt),
bp as (select arg_max(pt, pdf) as peak from b0), bt as (select 0.02 / sqrt(n) as thr from bh),
bs as (select min(pt) filter (pt > peak and pdf <= 10 * thr) as start, min(pt) filter (pt > peak and pdf <= thr) as stop from b0, bp, bt),
bl as (select regr_slope(ln(pdf), pt) as slope, regr_intercept(ln(pdf), pt) as intercept from b0, bs where pt >= start and pt < stop),
b as (select pt, case when pt >= stop then exp(intercept + slope * pt) else pdf end * n / {_TB} * {YEAR} as rate from b0, bs, bl, bh),
e as (select min(l_discount) + 0.01 as z0, max(l_discount) as z1, min(l_tax) - 0.04 as d0, max(l_tax) - 0.04 as d1, avg((l_returnflag <> 'R')::int) as found from lineitem),
c as (select a.volume + (a.volume1 - a.volume) * (e.z0 / 0.0002 - a.k) as v0, b.volume + (b.volume1 - b.volume) * (e.z1 / 0.0002 - b.k) as v1, d0, d1, found from e join cosmos a on a.k = floor(e.z0 / 0.0002) join cosmos b on b.k = floor(e.z1 / 0.0002)),
fg as (select pt, 30 * found * (v1 - v0) * 2 * pi() * (sin(d1) - sin(d0)) / 1e9 * pdf as rate from f, c)
select round(pt, 3) as pt, round(fg.rate, 10) as foreground, round(b.rate, 8) as background, round(fg.rate / (fg.rate + b.rate), 8) as p_astro from fg join b using (pt)
""")
def p_astro(v: Views):
    """Signals per year by statistic, of 30 a year and cubic Gpc and the share of the injections that is found, beside the background's events per year with its tail."""
    louder = v.ev.where("slide > 0 and detection_statistic is not null")
    n = louder.count()
    tail = sensitivity.kde_with_tail(sensitivity.kde(louder, "detection_statistic", _grid(v), "pt"), "pt", 0.02 / n**0.5)
    seen = v.table("lineitem").agg(F.count(F.lit(1)).alias("all"), F.count_if(col("l_returnflag") != "R").alias("found"))
    once = F.broadcast(_injected(v).join(F.broadcast(seen)).select(sensitivity.scale_factor(col("found"), col("all"), col("volume") / 1e9, 30.0).alias("scale")))
    both = sensitivity.kde(v.inj, "snr", _grid(v), "pt").join(tail.withColumnRenamed("pdf", "bg"), "pt").join(once)
    both = both.select("pt", (col("scale") * col("pdf")).alias("fg"), (col("bg") * n / _TB * YEAR).alias("bg"))
    return both.select(r(col("pt"), 3).alias("pt"), r(col("fg"), 10).alias("foreground"), r(col("bg"), 8).alias("background"), r(sensitivity.p_astro(col("fg"), col("bg")), 8).alias("p_astro"))


@query("class_probs", """
, p as (select user_id, avg((detection_statistic < 20)::int) as low, avg((detection_statistic > 60)::int) as high from ev where event_type = 'click' group by user_id),
e as (select event_id, user_id, 0.8 as p from ev where event_type = 'signup')
select event_id, round(p * coalesce(low, 0), 8) as bns, round(p * coalesce(high, 1), 8) as bbh, round(p - p * coalesce(low, 0) - p * coalesce(high, 1), 8) as nsbh, 0.2::double as terrestrial from e left join p using (user_id)
""")
def class_probs(v: Views):
    post = v.ev.where("event_type = 'click'").select("user_id", "detection_statistic")
    e = v.ev.where("event_type = 'signup'").select("event_id", "user_id").withColumn("p", F.lit(0.8))
    return sensitivity.class_probs(e, post, "user_id", "detection_statistic", 20.0, 60.0).select("event_id", *(r(col(k), 8).alias(k) for k in ("bns", "bbh", "nsbh")), r(col("terrestrial"), 8).alias("terrestrial"))


@query("survival_hist", """
, e as (select min(detection_statistic) as lo, max(detection_statistic) as hi from ev), b as (select least(floor((detection_statistic - lo) / ((hi - lo) / 100)), 99)::bigint as bin, count(*) as n from ev, e where detection_statistic is not null group by 1)
select bin, sum(coalesce(n, 0)) over (order by bin desc)::bigint as survivors, round(lo + (bin + 0.5) * (hi - lo) / 100, 6) as centre from range(0, 100) t(bin) left join b using (bin), e
""")
def survival_hist(v: Views):
    return sensitivity.survival(v.ev, "detection_statistic", 100).select("bin", "survivors", r(col("centre")).alias("centre"))


@query("latency_stats", """
, x as (select event_type, detection_statistic as x from ev where detection_statistic > 0), f as (select event_type, min(x) as lo, max(x) as hi, median(x) as median, quantile_cont(x, 0.9) as p90 from x group by event_type),
n as (select event_type, least(floor(ln(x / lo) / ln(hi / lo) * 29), 28)::bigint as bin, count(*) as n from x join f using (event_type) group by 1, 2)
select event_type, bin, coalesce(n, 0) as n, round(median, 6) as median, round(p90, 6) as p90 from f cross join range(0, 29) t(bin) left join n using (event_type, bin)
""")
def latency_stats(v: Views):
    return sensitivity.log_bins(v.ev, "event_type", "detection_statistic", 29).select("event_type", "bin", "n", r(col("median")).alias("median"), r(col("p90")).alias("p90"))


@query("event_rate", """
, e as (select date_trunc('hour', min(ts)) as a, max(ts) as b from events),
s as (select span, step, back from (values ('1 hour', interval 1 hour, interval 1 day), ('4 hours', interval 4 hour, interval 7 day), ('1 day', interval 1 day, interval 1000 day)) t(span, step, back)),
h as (select span, step, unnest(generate_series(a, b, step)) as h, b, back from e, s)
select span, epoch_us(h) // 1000000 as hour, count(event_id) as n from (select * from h where epoch_us(h) // 1000000 >= epoch_us(b) // 1000000 - epoch(back)) left join events on ts >= h and ts < h + step group by 1, 2
""")
def event_rate(v: Views):
    """Hours of the last day, four hours of the last week, and days of all time."""
    rows = v.events.withColumn("ts", col("ts").cast("timestamp"))
    parts = [sensitivity.rate(rows, "ts", s, back).select(F.lit(name).alias("span"), "hour", "n") for name, s, back in (("1 hour", 3600, 86400), ("4 hours", 4 * 3600, 7 * 86400), ("1 day", 86400, None))]
    return parts[0].union(parts[1]).union(parts[2])


#: The shares within 1, 2 and 3 sigma; and in SQL the least counts that have enough of the distribution at or below them.
_SHARES = {1: 0.682689, 2: 0.954499, 3: 0.997300}
_IFAR = f"""
, f as (select inj_id, {_TB} / {YEAR} / greatest(nb, 1) as ifar from (select inj_id, (select count(*) from ev where detection_statistic >= snr and slide > 0) as nb from inj)),
fe as (select *, {_TB} / {YEAR} / ifar as e from f), es as (select distinct e from fe),
pm as (select e, k, exp(k * ln(e) - e - lgamma(k + 1)) as p from (select e, unnest(range(greatest(floor(e - 9 * sqrt(e)) - 20, 0)::bigint, ceil(e + 9 * sqrt(e))::bigint + 30)) as k from es)),
cd as (select e, k, sum(p) over (partition by e order by k) as c from pm),
bd as (select e, {", ".join(f"greatest(min(k) filter (c >= {(1 - q) / 2!r}) - 0.5, 0)::double as low_{z}, (min(k) filter (c >= {(1 + q) / 2!r}) + 0.5)::double as high_{z}" for z, q in _SHARES.items())} from cd group by e)
"""


@query("ifar_curve", _IFAR + "select round(ifar, 8) as ifar, row_number() over (order by ifar desc, inj_id) as rank, round(e, 6) as expected, bd.* exclude (e) from fe join bd using (e)")
def ifar_curve(v: Views):
    """Each event's inverse rate and rank, the number of events expected at or above that, and where it lies within 1, 2 and 3 sigma."""
    f = _nb(v).withColumn("ifar", _TB / YEAR / F.greatest("nb", F.lit(1)))
    rows = ranks.running(f, "ifar", {"rank": "1L"}, then=("inj_id",)).withColumn("e", _TB / YEAR / col("ifar"))
    bands = [x.alias(f"{n}_{z}") for z, share in _SHARES.items() for n, x in zip(("low", "high"), sensitivity.count_band(col("e"), share))]
    return rows.select(r(col("ifar"), 8).alias("ifar"), "rank", r(col("e")).alias("expected"), *bands)


@query("timeslide_auroc", """
, pooled as (select slide, w, max(y) as y from (select slide, i, y, unnest(range(0, 180)) as w from series where slide > 0) where i >= w * 4 and i < w * 4 + 8 and w < 179 group by slide, w),
scored as (select y as score, 0 as y from pooled union all select avg(detection_statistic) * 3 as score, 1 as y from ev where event_type = 'purchase' group by user_id having avg(detection_statistic) is not null),
d as (select score, sum(y) as p, count(*) - sum(y) as n from scored group by score), c as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp, sum(p) over () as ap, sum(n) over () as an from d)
select round(sum((least(fp / an, 0.5) - (fp - n) / an) * ((tp - p) / ap + case when n > 0 then (tp - p) / ap + (p / ap) * (least(fp / an, 0.5) - (fp - n) / an) / (n / an) else tp / ap end) / 2) / 0.5, 6) as auroc from c where (fp - n) / an < 0.5
""")
def timeslide_auroc(v: Views):
    """The maxima of pooled background of each shift against the means over the views of each signal, up to half of the false alarms."""
    background = series.max_pool(v.series.where("slide > 0"), 8, ["slide"]).select(col("y").alias("score"), F.lit(0).alias("label"))
    views = v.ev.where("event_type = 'purchase'").groupBy("user_id").agg((F.avg("detection_statistic") * 3).alias("score"))
    rows = background.unionByName(views.where("score is not null").select("score", F.lit(1).alias("label")))
    return series.auroc(rows, "score", "label", 0.5).select(r(col("auroc"), 6).alias("auroc"))


@query("combine_scores", """
, s as (select y, unnest(['a', 'b', 'sum']) as scorer, unnest([score, (doc_id % 13) / 13.0, round(0.6 * score + 0.4 * ((doc_id % 13) / 13.0), 9)]) as score from roc),
d as (select scorer, score, sum(y) as p, count(*) - sum(y) as n from s group by all), c as (select *, sum(p) over (partition by scorer order by score desc) as tp, sum(p) over (partition by scorer) as ap, sum(n) over (partition by scorer) as an from d)
select scorer, round(sum(n / an * ((tp - p) + tp) / ap / 2), 8) as auroc from c group by scorer
""")
def combine_scores(v: Views):
    second = (col("doc_id") % 13) / 13.0
    rows = v.roc.withColumns({"second": second}).withColumn("both", F.round(0.6 * col("score") + 0.4 * col("second"), 9))
    parts = [series.auroc(rows, k, "y").select(F.lit(n).alias("scorer"), r(col("auroc"), 8).alias("auroc")) for k, n in (("score", "a"), ("second", "b"), ("both", "sum"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("view_mean", "select l_orderkey, round(avg(l_extendedprice), 6) as score from lineitem group by l_orderkey")
def view_mean(v: Views):
    return v.table("lineitem").groupBy("l_orderkey").agg(r(F.avg("l_extendedprice")).alias("score"))


@query("livetime_from_logs", """
, s as (select *, lag(t) over w as before, last_value(case event_type when 'error' then 0 else 1 end) over (partition by ifo order by t, event_id rows between unbounded preceding and 1 preceding) as state from states window w as (partition by ifo order by t, event_id))
select ifo, round(sum(case when coalesce(state, 1) = 1 then coalesce(t - before, 0) else 0 end), 4) as live from s group by ifo
""")
def livetime_from_logs(v: Views):
    return series.livetime(v.states, {"error": "close", "signup": "open"}, ["ifo"], "t", "event_type").select("ifo", r(col("live"), 4).alias("live"))


@query("last_status", "select user_id, coalesce(arg_max(event_type = 'signup', ts) filter (event_type in ('signup', 'error')), true) as ready from events group by user_id")
def last_status(v: Views):
    return series.last_state(v.events, "signup", "error", ["user_id"], "ts", "event_type")


@query("acceptance", "select slide, count(*) as drawn, count(*) filter (snr >= 50) as accepted, count(*) filter (snr < 50) as rejected, round(avg((snr >= 50)::int), 8) as fraction from inj group by slide")
def acceptance(v: Views):
    ok = F.count_if(col("snr") >= 50)
    return v.inj.groupBy("slide").agg(F.count(F.lit(1)).alias("drawn"), ok.alias("accepted"), F.count_if(col("snr") < 50).alias("rejected"), r(ok / F.count(F.lit(1)), 8).alias("fraction"))


@query("posterior_summary", "select user_id, round(avg(detection_statistic), 6) as mean, round(median(detection_statistic), 6) as median from ev group by user_id")
def posterior_summary(v: Views):
    return v.ev.groupBy("user_id").agg(r(F.avg("detection_statistic")).alias("mean"), r(F.median("detection_statistic")).alias("median"))


@query("source_medians", ", m as (select o_custkey, median(o_totalprice) as m from orders group by o_custkey) select c_custkey, round(m, 4) as median_mass from customer left join m on c_custkey = o_custkey")
def source_medians(v: Views):
    m = v.table("orders").groupBy(col("o_custkey").alias("c_custkey")).agg(r(F.median("o_totalprice"), 4).alias("median_mass"))
    return v.table("customer").select("c_custkey").join(m, "c_custkey", "left")
