"""Series, windows, budgets and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import detectors
from ..operators import cosmology, matching, priors, ranks, sampling, sensitivity, series, signal, strain
from ..sources.store import fixed
from .registry import Views, query

col = F.col


def r(x, n=6):
    return F.round(x, n)


_BOX = ", box as (select slide, i, sum(y) over (partition by slide order by i rows between 6 preceding and current row) / 7 as y from series)"
#: The greedy walk as a recursion: at each step the first largest of the next ``half`` samples, if larger, else a stop.
_WALK = """
, nxt as (select slide, i, y, max(y) over w as ahead, (select min(b.i) from {t} b where b.slide = a.slide and b.i between a.i + 1 and a.i + {h} and b.y = (select max(d.y) from {t} d where d.slide = a.slide and d.i between a.i + 1 and a.i + {h})) as best
  from {t} a window w as (partition by slide order by i rows between 1 following and {h} following)),
walk as (
  select slide, (select min(b.i) from {t} b where b.slide = s.slide and b.i < {h} and b.y = (select max(d.y) from {t} d where d.slide = s.slide and d.i < {h})) as i, false as stopped from (select distinct slide from {t}) s
  union all
  select n.slide, case when n.ahead > n.y then n.best else n.i + {h} + 1 end, false from walk w join nxt n on n.slide = w.slide and n.i = w.i
), peaks as (select distinct n.slide, n.i, n.y from walk join nxt n using (slide, i) where not coalesce(n.ahead > n.y, false))
"""


def _box(v: Views):
    return series.boxcar(v.series, 7, ["slide"])


@query("boxcar", _BOX + " select slide, i, round(y, 6) as y from box")
def boxcar(v: Views):
    return _box(v).select("slide", "i", r(col("y")).alias("y"))


@query("cluster_peaks", _WALK.format(t="series", h=12) + " select slide, i, round(y, 6) as y from peaks")
def cluster_peaks(v: Views):
    return series.cluster_peaks(v.series, 24, ["slide"]).select("slide", "i", r(col("y")).alias("y"))


@query("search", _BOX + _WALK.format(t="box", h=12) + f"""
select slide, i, round(y, 6) as y, (select count(*) from peaks b where b.slide > 0 and b.y >= p.y) as nb,
  round(greatest({c.YEAR_FAR} * (select count(*) from peaks b where b.slide > 0 and b.y >= p.y) / 7776000.0, {c.YEAR_FAR} / 7776000.0), 6) as far
from peaks p where slide = 0
""")
def search(v: Views):
    """Score series of every time slide to zero-lag candidates with their false-alarm rates."""
    peaks = series.cluster_peaks(_box(v), 24, ["slide"])
    counted = ranks.counts_at_least(peaks.where("slide > 0"), peaks.where("slide = 0"), "y", "y")
    out = counted.withColumn("far", r(sensitivity.far(col("nb"), F.lit(7776000.0))))
    return out.select("slide", "i", r(col("y")).alias("y"), "nb", "far")


@query("unfold_windows", """
, x as (select ifo, block * 64 + k - 1 as i, samples[k]::double as v from (select *, unnest(range(1, 65)) as k from win))
select i0 // 64 as block, ifo, i0 % 64 // 8 as k, round(sum(v), 5) as total from (select a.ifo, a.i as i0, b.v from (select *, unnest(range(i, i + 16)) as j from x where i % 8 = 0) a join x b on a.ifo = b.ifo and b.i = j) group by ifo, i0 having count(*) = 16
""")
def unfold_windows(v: Views):
    """Windows of 16 samples, 8 apart, across the blocks' borders."""
    each = strain.windows(v.win, ["ifo"], "block", "samples", 16, 8)
    return each.select("block", "ifo", col("k").cast("long").alias("k"), r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("drop_burn_in", "select slide, i - 64 as i, y from series where i >= 64")
def drop_burn_in(v: Views):
    return series.drop_burn_in(v.series, 64).select("slide", "i", "y")


@query("max_pool", "select slide, w, max(y) as y from (select slide, i, y, unnest(range(0, 180)) as w from series) where i >= w * 4 and i < w * 4 + 8 and w < 179 group by slide, w")
def max_pool(v: Views):
    return series.max_pool(v.series, 8, ["slide"])


@query("accept_until_quota", ", n as (select inj_id, snr >= 50 as ok, sum((snr >= 50)::int) over (order by inj_id) as s from inj) select inj_id, ok from n where s - ok::int < 300")
def accept_until_quota(v: Views):
    return sampling.accept_until(v.inj.select("inj_id", (col("snr") >= 50).alias("ok")), "ok", 300, "inj_id")


@query("train_val_split", """
, d as (select o_orderkey, start, round((stop - start) * 1000000)::bigint as d from seg),
n as (select o_orderkey, sum(d) over (order by start desc, o_orderkey desc) - d as before from d)
select o_orderkey, before < 20000000000000 as validation from n
""")
def train_val_split(v: Views):
    """Newest segments validate until they add up to the least duration, in whole microseconds: so sums are exact in any order."""
    rows = v.seg.select("o_orderkey", "start", F.round((col("stop") - col("start")) * 1000000).cast("long").alias("duration"))
    n = ranks.running(rows.withColumn("back", -col("o_orderkey")), "start", {"total": "duration"}, then=("back",))
    return n.select("o_orderkey", (col("total") - col("duration") < 20000000000000).alias("validation"))


@query("prev_ready", "select event_id, ifo, coalesce(lag(event_type = 'signup') over (partition by ifo order by t, event_id), true) as ready from states")
def prev_ready(v: Views):
    rows = matching.earlier(v.states, ["ifo"], "t", {"ready": col("event_type") == "signup"}, 3600.0, ("event_id",))
    return rows.select("event_id", "ifo", F.coalesce("ready", F.lit(True)).alias("ready"))


@query("decimate", "select block, ifo, k, samples[k * 4 + 1]::double as v from (select *, unnest(range(0, 16)) as k from win)")
def decimate(v: Views):
    kept = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.element_at("samples", k * 4 + 1).cast("double"))
    return v.win.select("block", "ifo", F.posexplode(kept).alias("k", "v")).select("block", "ifo", col("k").cast("long").alias("k"), "v")


@query("refractory", """
, n as (select slide, detection_time as t, event_id from ev where detection_statistic > 100),
keep as (
  select slide, min(t) as t from n group by slide
  union all
  select k.slide, (select min(n.t) from n where n.slide = k.slide and n.t - k.t >= 3600) from keep k where exists (select 1 from n where n.slide = k.slide and n.t - k.t >= 3600)
) select slide, t from keep
""")
def refractory(v: Views):
    rows = v.ev.where("detection_statistic > 100").select("slide", col("detection_time").alias("t"))
    return series.refractory(rows, ["slide"], "t", 3600.0)


@query("injection_grid", """
, g as (select o_orderkey, start, stop, k from seg, range(0, 60) t(k) where start + 12 + k * 25000 < stop - 1 - 12)
select o_orderkey, k, round(12 + k * 25000.0 + (('0x' || substr(md5(o_orderkey::varchar || '|' || k::varchar), 1, 12))::bigint / 281474976710656.0 - 0.5) * 2, 4) as since_start from g
""")
def injection_grid(v: Views):
    rows = priors.injection_grid(v.seg, spacing=24992.0, buffer=8.0, duration=8.0, max_shift=1.0)
    # exact to the sample only as a time since the segment's start
    jitter = (sampling.uniform(col("o_orderkey"), col("k")) - 0.5) * 2
    return rows.select("o_orderkey", "k", r(12 + col("k") * 25000.0 + jitter, 4).alias("since_start"))


_HASH = "('0x' || substr(md5(i::varchar || '|{}'), 1, 12))::bigint / 281474976710656.0"


@query("sample_prior", cosmology.SQL + f"""
, u as (select i, {_HASH.format('mass_1|3')} as u1, {_HASH.format('mass_2|3')} as u2, {_HASH.format('dec|3')} as u3, {_HASH.format('psi|3')} as u4, {_HASH.format('redshift|3')} as u5 from (select event_id as i from ev)),
m as (select *, pow(pow(5, -1.35) + u1 * (pow(100, -1.35) - pow(5, -1.35)), 1 / -1.35) as m1, u5 * (select volume from cosmos where k = 2500) as t from u),
p as (select i, m1, pow(pow(5, 2) + u2 * (pow(m1, 2) - pow(5, 2)), 0.5) as m2, asin(2 * u3 - 1) as dec, pi() * u4 as psi, z + (z1 - z) * (t - volume) / (volume1 - volume) as redshift from m asof join cosmos on t >= volume)
select i, round(m1, 4) as mass_1, round(m2, 4) as mass_2, round(dec, 6) as dec, round(psi, 6) as psi, round(redshift, 7) as redshift, round(m1 * (1 + redshift), 4) as detector_mass_1 from p where m2 / m1 between 0.02 and 1
""")
def sample_prior(v: Views):
    """Draws for every event's id from a named population, by hashes instead of a generator's state; redshifts uniform in comoving volume and time."""
    prior = {
        "mass_1": priors.power_law(-2.35, 5.0, 100.0), "mass_2": priors.power_law(1.0, 5.0, col("mass_1")),
        "dec": priors.cosine(), "psi": priors.uniform(0.0, 3.141592653589793), "redshift": priors.in_universe(v.spark, 0.5),
    }
    derived = lambda d: d.withColumns({"q": col("mass_2") / col("mass_1"), "detector": col("mass_1") * (1 + col("redshift"))})
    drawn = priors.draw(v.ev.select(col("event_id").alias("i")), "i", prior, seed=3, convert=derived, keep=col("q").between(0.02, 1))
    return drawn.select(
        "i", r(col("mass_1"), 4).alias("mass_1"), r(col("mass_2"), 4).alias("mass_2"), r(col("dec")).alias("dec"), r(col("psi")).alias("psi"),
        r(col("redshift"), 7).alias("redshift"), r(col("detector"), 4).alias("detector_mass_1"),
    )


#: A burst's two polarisations, sample by sample: an envelope about sample 32 with a tone under it.
_BURST = {p: f"amp * exp(-pow(({{n}} - 32) / tau, 2)) * {f}(6.283185307179586e0 * freq * ({{n}} - 32) / 64 + phase)" for p, f in (("plus", "cos"), ("cross", "sin"))}
_IFOS = {"H1": "H1", "L1": "L1"}
_ANTENNA_SQL = " union all ".join(f"select *, '{i}' as ifo, {detectors.antenna(d)[0]} as fp, {detectors.antenna(d)[1]} as fc, 6 + floor(({detectors.delay(d)}) * 256 + 0.5)::bigint as delay from dr" for i, d in _IFOS.items())


@query("reject_by_snr", f"""
, quota as (select count(*) // 4 as quota from inj),
x as (select block, ifo, k - 1 as n, samples[k]::double * (0.5 - 0.5 * cos(2 * pi() * (k - 1) / 64)) as v from (select *, unnest(range(1, 65)) as k from win)),
fp as (select block, ifo, f, (pow(sum(v * cos(2 * pi() * f * n / 64)), 2) + pow(sum(v * sin(2 * pi() * f * n / 64)), 2)) * case when f in (0, 32) then 1 else 2 end / (64 * 24.0) as p from x, range(0, 33) t(f) group by block, ifo, f),
psd as (select ifo, f, median(p) as psd from fp group by ifo, f),
dr as (select i, 0.3 * pow(10 / 0.3, {_HASH.format('amp|5')}) as amp, 3 + 7 * {_HASH.format('tau|5')} as tau, 4 + 20 * {_HASH.format('freq|5')} as freq, 2 * pi() * {_HASH.format('phase|5')} as phase,
  2 * pi() * {_HASH.format('ra|5')} as ra, asin(2 * {_HASH.format('dec|5')} - 1) as dec, pi() * {_HASH.format('psi|5')} as psi from (select unnest(range(0, (select quota * 8 + 100 from quota))) as i)),
an as ({_ANTENNA_SQL}),
h as (select i, ifo, n, case when n >= delay then fp * {_BURST['plus'].format(n='(n - delay)')} + fc * {_BURST['cross'].format(n='(n - delay)')} else 0 end as v from an, range(0, 64) t(n)),
ft as (select i, ifo, f, pow(sum(v * cos(2 * pi() * f * n / 64)), 2) + pow(sum(v * sin(2 * pi() * f * n / 64)), 2) as p from h, range(2, 31) t(f) group by i, ifo, f),
s as (select i, sqrt(sum(4 * p / psd / 4096)) as snr from ft join psd using (ifo, f) group by i),
n as (select *, sum((snr >= 8)::int) over (order by i) - (snr >= 8)::int as before from s)
select i, round(snr, 5) as snr, snr >= 8 as accepted from n, quota where before < quota
""")
def reject_by_snr(v: Views):
    """Bursts drawn until a quota is loud in the noise of ``win``, seen by two detectors; quiet ones before that are the rejected ones."""
    noise = signal.welch(v.win, "ifo", "samples", 64, 64.0).withColumn("bin", col("bin").cast("int"))
    noise = fixed(noise, "psd")  # a row per detector and bin
    two_pi = 6.283185307179586
    prior = {
        "amp": priors.log_uniform(0.3, 10.0), "tau": priors.uniform(3.0, 10.0), "freq": priors.uniform(4.0, 24.0), "phase": priors.uniform(0.0, two_pi),
        "ra": priors.uniform(0.0, two_pi), "dec": priors.cosine(), "psi": priors.uniform(0.0, two_pi / 2),
    }
    seen = F.array(*(
        F.struct(F.lit(i).alias("ifo"), F.expr(detectors.antenna(d)[0]).alias("fp"), F.expr(detectors.antenna(d)[1]).alias("fc"), (F.floor(F.expr(detectors.delay(d)) * 256 + 0.5) + 6).cast("int").alias("delay"))
        for i, d in _IFOS.items()
    ))
    waves = {p: F.expr(f"transform(sequence(0, 63), n -> {e.format(n='n').replace('e0', 'D')})") for p, e in _BURST.items()}

    def make(ids):
        d = priors.draw(ids, "id", prior, seed=5).withColumns(waves).select("id", "plus", "cross", F.inline(seen))
        d = d.withColumn("h", signal.project(col("plus"), col("cross"), col("fp"), col("fc"), col("delay")))
        each = signal.snr(d, noise, ["id", "ifo"], "h", 2, 30, 1 / 4096, of=["ifo"])
        return each.groupBy("id").agg(F.sqrt(F.sum(col("snr") * col("snr"))).alias("snr")).withColumn("accepted", col("snr") >= 8)

    quota = v.inj.count() // 4
    drawn = priors.until_accepted(v.spark, quota, make, "accepted", most=8 * quota + 100)
    return drawn.select(col("id").alias("i"), r(col("snr"), 5).alias("snr"), "accepted")


@query("enumerate_timeslides", """
, s as (select o_orderkey, start, stop, j, case when j % 2 = 0 then j // 2 + 1 else -(j // 2 + 1) end as shift from seg, range(0, 40) t(j)),
d as (select *, greatest(stop - start - 1.5 - abs(shift), 0) as dur from s), t as (select *, sum(dur) over (order by j, start, o_orderkey) as total from d)
select o_orderkey, shift, round(least(dur, dur - (total - 3000000000)), 4) as used from t where total - dur < 3000000000 - 0.001
""")
def enumerate_timeslides(v: Views):
    return priors.timeslides(v.seg, "o_orderkey", kernel=1.5, livetime=3000000000.0).select("o_orderkey", "shift", r(col("used"), 4).alias("used"))


@query("worker_seed", "select o_orderkey, 42 + ('0x' || substr(md5(o_orderkey::varchar || '|0|1'), 1, 12))::bigint as seed from seg")
def worker_seed(v: Views):
    """A seed per job and its shifts: a hash of what names the job, plus the campaign's."""
    return v.seg.select("o_orderkey", (sampling.hashed(col("o_orderkey"), "0", "1") + 42).alias("seed"))


@query("mass_grid", "select user_id, k, round(1.2 * pow(60 / 1.2, k / 31.0), 6) as log_mass, round(1.2 + k * (60 - 1.2) / 31, 6) as linear_mass from (select distinct user_id from events), range(0, 32) t(k)")
def mass_grid(v: Views):
    grid = priors.mass_grid(v.spark, 1.2, 60.0, 32)
    return v.events.select("user_id").distinct().join(F.broadcast(grid)).select("user_id", "k", r(col("log_mass")).alias("log_mass"), r(col("linear_mass")).alias("linear_mass"))
