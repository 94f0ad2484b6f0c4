"""Jobs over windows of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detectors
from ..operators import priors, qtransform, sampling, signal, strain
from ..sources.store import fixed
from .joins import _INJECTED, injected
from .registry import Views, query

col = F.col


def r(x, n=6):
    return F.round(x, n)


_X = ", x as (select block, ifo, k - 1 as n, samples[k]::double as v from (select *, unnest(range(1, 65)) as k from win)), "
_FT = _X + "ft as (select block, ifo, f, sum(v * cos(2 * pi() * f * n / 64)) as re, -sum(v * sin(2 * pi() * f * n / 64)) as im from x, range(0, 33) t(f) group by all) "


def _total(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


@query("fft_spectrum", _FT + "select block, ifo, f - 3 as bin, round(sqrt(re * re + im * im), 6) as size from ft where f between 3 and 20")
def fft_spectrum(v: Views):
    each = v.win.select("block", "ifo", F.posexplode(signal.spectrum(col("samples"), 3, 20)).alias("bin", "size"))
    return each.select("block", "ifo", col("bin").cast("long").alias("bin"), r(col("size")).alias("size"))


@query("welch_psd", _X + """
fr as (select block, ifo, s, n - s * 16 as j, v * (0.5 - 0.5 * cos(2 * pi() * (n - s * 16) / 32)) as v from x, range(0, 3) t(s) where n between s * 16 and s * 16 + 31),
p as (select block, ifo, s, f, (pow(sum(v * cos(2 * pi() * f * j / 32)), 2) + pow(sum(v * sin(2 * pi() * f * j / 32)), 2)) * case when f in (0, 16) then 1 else 2 end / (64 * 12.0) as p from fr, range(0, 17) t(f) group by block, ifo, s, f)
select ifo, f as bin, round(median(p), 9) as psd from p group by ifo, f
""")
def welch_psd(v: Views):
    return signal.welch(v.win, "ifo", "samples", 32, 64.0).select("ifo", "bin", r(col("psd"), 9).alias("psd"))


@query("snr", _FT + ", s as (select block, ifo, sqrt(4 * sum((re * re + im * im) / (1 + f)) * 0.5) as snr from ft where f between 2 and 30 group by block, ifo) select block, round(sqrt(sum(snr * snr)), 6) as snr from s group by block")
def snr(v: Views):
    psd = v.spark.range(33).select(col("id").cast("int").alias("bin"), (1.0 + col("id")).alias("psd"))
    each = signal.snr(v.win, psd, ["block", "ifo"], "samples", 2, 30, 0.5)
    return each.groupBy("block").agg(r(F.sqrt(F.sum(col("snr") * col("snr")))).alias("snr"))


#: Both series whitened: medians over the 28 frames of the four blocks before, a filter of eight samples.
_WHITE = _INJECTED.rstrip() + ", " + _X.removeprefix(", ").rstrip(", ") + """,
allx as materialized (select 'background' as kind, block, ifo, block * 64 + n as i, n, v from x union all select 'injected', block, ifo, block * 64 + n, n, v from ix),
hp as (select block, ifo, s, f, pow(sum(v * w * cos(2 * pi() * f * j / 16)), 2) + pow(sum(v * w * sin(2 * pi() * f * j / 16)), 2) as p
  from (select block, ifo, s, n - s * 8 as j, v, 0.5 - 0.5 * cos(2 * pi() * (n - s * 8) / 16) as w from x, range(0, 7) t(s) where n between s * 8 and s * 8 + 15), range(0, 9) u(f) group by block, ifo, s, f),
hm as materialized (select block + ahead as block, ifo, f, median(p) * 2 / (64 * 6.0) as d from hp, range(1, 5) t(ahead) group by 1, ifo, f having count(distinct block) = 4),
hd as materialized (select block, ifo, k, 1 / sqrt(greatest(d + (coalesce(d1, d) - d) * (k * 8 / 36.0 - f), 1e-30)) as a from (select *, lead(d) over (partition by block, ifo order by f) as d1 from hm) join (select k, floor(k * 8 / 36.0) as f from range(0, 37) u(k)) using (f)),
hk as materialized (select block, ifo, t, sum(a * cos(2 * pi() * k * t / 72) * case when k in (0, 36) then 1 else 2 end) / 72 * (0.5 + 0.5 * cos(2 * pi() * t / 8)) as c from hd, range(-4, 4) u(t) group by block, ifo, t),
taps as materialized (select kind, ifo, block, n, i - t as i, c from allx join hk using (block, ifo) where block < (select max(block) from win)),
hy as materialized (select kind, ifo, taps.block, taps.n, taps.block * 64 + taps.n as i, sum(v * c) * sqrt(2 / 64.0) as y from taps join allx using (kind, ifo, i) group by kind, ifo, taps.block, taps.n)
"""


def whitened(v: Views):
    """(kind, block, ifo, white): the strain and the strain with signals, under one density of the blocks before, which that without signals gives."""
    plain = v.win.select("block", "ifo", F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    psd = strain.rolling_psd(plain, ["ifo"], "block", "samples", 16, 64.0, 4)
    both = plain.select(F.lit("background").alias("kind"), "block", "ifo", "samples").unionByName(injected(v).select(F.lit("injected").alias("kind"), "block", "ifo", "samples"))
    return strain.whiten(both, psd, ["ifo"], "block", "samples", 64.0, 8, apart=["kind"])


@query("whiten", _WHITE + """
select kind, ifo, block, n // 16 as k, round(sqrt(sum(y * y) / 32), 4) as rms
from (select a.kind, a.ifo, a.block, a.n, b.y from (select *, unnest(range(i, i + 32)) as j from hy where n % 16 = 0) a join hy b on a.kind = b.kind and a.ifo = b.ifo and b.i = j)
group by kind, ifo, block, n having count(*) = 32
""")
def whiten(v: Views):
    """Windows of 32 whitened samples, 16 apart, of both series."""
    each = strain.windows(whitened(v), ["kind", "ifo"], "block", "white", 32, 16)
    return each.select("kind", "ifo", "block", col("k").cast("long").alias("k"), r(F.sqrt(signal.dot(col("window"), col("window")) / 32), 4).alias("rms"))


@query("freq_features", _FT + "select block, ifo, round(sum(re), 5) as re, round(sum(im), 5) as im, round(sum(1 / sqrt(1 + f)), 5) as inverse_asd from ft where f > 2 and f < 30 group by block, ifo")
def freq_features(v: Views):
    """Real and imaginary parts and the inverse amplitude density, within the band and without its ends."""
    z = v.win.withColumn("z", signal.rfft(col("samples")))
    band = lambda c: F.slice(c, 4, 27)
    inverse = F.transform(F.sequence(F.lit(3), F.lit(29)), lambda f: 1 / F.sqrt(1.0 + f))
    return z.select("block", "ifo", r(_total(band(col("z.real"))), 5).alias("re"), r(_total(band(col("z.imag"))), 5).alias("im"), r(_total(inverse), 5).alias("inverse_asd"))


#: The first view: 96 samples from a block's first on, every other one; planes of two Q.
_QS, _VIEW, _QRATE, _CYCLES = (4.0, 6.0), 48, 32.0, 4.0
_QROWS = ", ".join(f"({q!r}::double, {k}, {x.bin}, {x.half}, {x.tiles})" for q in _QS for k, x in enumerate(qtransform.rows(q, _VIEW, _QRATE, cycles=_CYCLES)))


@query("spectrogram", _X.rstrip(", ") + f"""
, vw as (select a.block, a.ifo, (b.block - a.block) * 32 + b.n // 2 as m, b.v from (select distinct block, ifo from x) a join x b on a.ifo = b.ifo and b.block in (a.block, a.block + 1) and b.n % 2 = 0 and (b.block = a.block or b.n < 32)),
full_ as (select block, ifo from vw group by block, ifo having count(*) = {_VIEW}),
ft as (select block, ifo, f, sum(v * cos(2 * pi() * f * m / {_VIEW})) as re, -sum(v * sin(2 * pi() * f * m / {_VIEW})) as im from vw join full_ using (block, ifo), range(0, {_VIEW // 2 + 1}) t(f) group by block, ifo, f),
qr(q, row, bin, half, tiles) as (values {_QROWS}),
w as (select block, ifo, q, row, tiles, d, re * pow(1 - pow(d / half::double, 2), 2) as re, im * pow(1 - pow(d / half::double, 2), 2) as im from (select *, unnest(range(-half, half + 1)) as d from qr) join ft on f = bin + d),
z as (select block, ifo, q, row, tile, pow(sum(re * cos(2 * pi() * d * tile / tiles) - im * sin(2 * pi() * d * tile / tiles)), 2) + pow(sum(re * sin(2 * pi() * d * tile / tiles) + im * cos(2 * pi() * d * tile / tiles)), 2) as e
  from (select *, unnest(range(0, tiles)) as tile from w) group by block, ifo, q, row, tile),
n as (select *, e / median(e) over (partition by block, ifo, q, row) as energy from z), best as (select block, ifo, arg_max(q, energy) as q from n group by block, ifo)
select block, ifo, q, row, tile, round(energy, 5) as energy from n join best using (block, ifo, q)
""")
def spectrogram(v: Views):
    """Tiles of the plane with the loudest one, of windows that go on into the next block."""
    rows = strain.beside(v.win, ["ifo"], "block", "samples", after=32).where("size(_after) = 32")
    line = F.concat("samples", "_after")
    view = F.transform(F.sequence(F.lit(0), F.lit(_VIEW - 1)), lambda m: F.element_at(line, 2 * m + 1))
    q = rows.select("block", "ifo", qtransform.scan(view, _QS, _QRATE, cycles=_CYCLES).alias("s"))
    tiles = q.select("block", "ifo", "s.q", F.posexplode("s.tiles").alias("row", "line")).select("block", "ifo", "q", "row", F.posexplode("line").alias("tile", "energy"))
    return tiles.select("block", "ifo", "q", "row", col("tile").cast("long").alias("tile"), r(col("energy"), 5).alias("energy"))


@query("heterodyne", _X + """
g as (select k, 1.2 * pow(60 / 1.2, k / 7.0) as mc from range(0, 8) t(k))
select block, ifo, k, round(sum(v * cos(2 * pi() * 5 / mc * pow((64 - n) / 16.0, 0.625))), 5) as re, round(-sum(v * sin(2 * pi() * 5 / mc * pow((64 - n) / 16.0, 0.625))), 5) as im from x, g where n >= 32 group by block, ifo, k
""")
def heterodyne(v: Views):
    t = signal.heterodyne(v.win, priors.mass_grid(v.spark, 1.2, 60.0, 8), "samples", 16.0, 32)
    part = lambda p: r(F.aggregate("turned", F.lit(0.0), lambda s, x: s + x[p]), 5)
    return t.select("block", "ifo", "k", part("real").alias("re"), part("imag").alias("im"))


@query("resample", _X + """
h0 as (select j, case when j = 7 then 1 else sin(pi() * (j - 7) / 4.0) / (pi() * (j - 7) / 4.0) end * (0.54 - 0.46 * cos(2 * pi() * j / 14)) as h from range(0, 15) t(j)), h as (select j, h / (select sum(h) from h0) as h from h0),
g as (select ifo, block * 64 + n as i, v from x)
select ifo, o // 64 as block, (o % 64) // 4 as k, round(sum(h * v), 6) as v from (select distinct ifo, i as o from g where i % 4 = 0) a join h on true join g b on b.ifo = a.ifo and b.i = a.o + j - 7 group by a.ifo, o
""".replace("select ifo, o // 64", "select a.ifo, o // 64"))
def resample(v: Views):
    low = signal.resample(v.win, "ifo", "block", "samples", 4, 15)
    return low.select("ifo", "block", F.posexplode("samples").alias("k", "v")).select("ifo", "block", col("k").cast("long").alias("k"), r(col("v")).alias("v"))


@query("freq_whiten", _X + """
m as (select block, ifo, avg(v) as m from x group by all),
w as (select block, ifo, n, (v - m) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) as v from x join m using (block, ifo)),
fw as (select block, ifo, f, sum(v * cos(2 * pi() * f * n / 64)) / sqrt(1 + f) as re, -sum(v * sin(2 * pi() * f * n / 64)) / sqrt(1 + f) as im from w, range(0, 33) t(f) where f between 2 and 30 group by block, ifo, f)
select block, ifo, round(sum(re), 5) as re, round(sum(im), 5) as im from fw group by block, ifo
""")
def freq_whiten(v: Views):
    w = signal.freq_whiten(v.win, "samples", [1.0 + f for f in range(33)], 2, 30)
    return w.select("block", "ifo", r(_total(col("white.real")), 5).alias("re"), r(_total(col("white.imag")), 5).alias("im"))


_U = "(('0x' || substr(md5({}), 1, 12))::bigint / 281474976710656.0)"
_KEY = "block::varchar || '|' || ifo || '|{}'"


@query("augment_flip", f"select block, ifo, round(case when {_U.format(_KEY.format('sign'))} < 0.5 then -1 else 1 end * case when {_U.format(_KEY.format('time'))} < 0.5 then samples[64] else samples[1] end::double, 6) as first from win")
def augment_flip(v: Views):
    x = v.win.withColumn("samples", signal.flip(col("samples"), col("block"), col("ifo")))
    return x.select("block", "ifo", r(col("samples")[0].cast("double")).alias("first"))


@query("swap_channels", """
, n as (select block, row_number() over (order by md5(block::varchar || '|swap'), block) - 1 as k, case when ('0x' || substr(md5(block::varchar || '|channel'), 1, 12))::bigint % 2 = 0 then 'H1' else 'L1' end as c from (select distinct block from win)),
h as (select greatest(floor(count(*) * 0.16 / 2), 1)::bigint as h from n),
p as (select a.block, b.block as other, case when a.k < h then a.c else b.c end as ifo from h, n a join n b on b.k = case when a.k < h then a.k + h else a.k - h end where a.k < 2 * h)
select w.block, w.ifo, p.other is not null as swapped, round(coalesce(o.samples[1], w.samples[1])::double, 6) as first from win w left join p on p.block = w.block and p.ifo = w.ifo left join win o on o.block = p.other and o.ifo = p.ifo
""")
def swap_channels(v: Views):
    """Of the blocks a fraction is chosen by hash, an even number and two at least; each of its first half exchanges one channel with one of the second."""
    from ..operators.ranks import row_ids

    blocks = v.win.select("block").distinct().withColumn("mix", F.md5(F.concat_ws("|", col("block").cast("string"), F.lit("swap"))))
    half = max(int(blocks.count() * 0.16 / 2), 1)
    chosen = row_ids(blocks, "mix", ("block",), name="k").where(col("k") < 2 * half).withColumn("c", F.when(sampling.hashed(col("block"), "channel") % 2 == 0, "H1").otherwise("L1"))
    a = chosen.where(col("k") < half).select("block", "k", "c")
    b = chosen.where(col("k") >= half).select(col("block").alias("other"), (col("k") - half).alias("k"))
    one = a.join(b, "k").select("block", "other", col("c").alias("ifo"))
    both = one.union(one.select(col("other").alias("block"), col("block").alias("other"), "ifo"))
    given = v.win.select(col("block").alias("other"), "ifo", col("samples").alias("theirs"))
    out = v.win.join(both, ["block", "ifo"], "left").join(given, ["other", "ifo"], "left")
    return out.select("block", "ifo", col("other").isNotNull().alias("swapped"), r(F.coalesce("theirs", "samples")[0].cast("double")).alias("first"))


@query("mute_channels", """
, b as (select block, row_number() over (order by block) - 1 as k from (select distinct block from win)), m as (select count(*) as m from b),
p as (select distinct block, case when ('0x' || substr(md5(d::varchar || '|channel'), 1, 12))::bigint % 2 = 0 then 'H1' else 'L1' end as ifo
  from m, b join (select d, ('0x' || substr(md5(d::varchar || '|mute'), 1, 12))::bigint as h from (select k as d from b)) t on b.k = h % m where d < floor(m * 0.24))
select w.block, w.ifo, p.block is not null as muted, case when p.block is null then round(samples[1]::double, 6) else 0 end as first from win w left join p using (block, ifo)
""")
def mute_channels(v: Views):
    """As many draws as a fraction of the blocks, with replacement; each mutes one channel of its block."""
    from ..operators.ranks import row_ids

    blocks = row_ids(v.win.select("block").distinct(), "block", name="k")
    m = blocks.count()
    picks = v.spark.range(int(m * 0.24)).select((sampling.hashed(col("id"), "mute") % max(m, 1)).alias("k"), F.when(sampling.hashed(col("id"), "channel") % 2 == 0, "H1").otherwise("L1").alias("ifo"))
    muted = picks.distinct().join(blocks, "k").select("block", "ifo", F.lit(True).alias("muted"))
    out = v.win.join(muted, ["block", "ifo"], "left")
    quiet = F.when(col("muted"), F.array_repeat(F.lit(0.0), 64)).otherwise(F.transform("samples", lambda x: x.cast("double")))
    return out.select("block", "ifo", F.coalesce("muted", F.lit(False)).alias("muted"), r(quiet[0]).alias("first"))


#: Noise by detector and bin: medians of whole blocks' power.
_NOISE = """
, nx as (select block, ifo, k - 1 as n, samples[k]::double * (0.5 - 0.5 * cos(2 * pi() * (k - 1) / 64)) as v from (select *, unnest(range(1, 65)) as k from win)),
np as (select block, ifo, f, (pow(sum(v * cos(2 * pi() * f * n / 64)), 2) + pow(sum(v * sin(2 * pi() * f * n / 64)), 2)) * case when f in (0, 32) then 1 else 2 end / (64 * 24.0) as p from nx, range(0, 33) t(f) group by block, ifo, f),
psd as materialized (select ifo, f, median(p) as psd from np group by ifo, f)
"""
#: Network SNRs of a table hh (block, ifo, n, v), then what a permutation gives them.
_SNRS = """
hf as (select block, ifo, f, pow(sum(v * cos(2 * pi() * f * n / 64)), 2) + pow(sum(v * sin(2 * pi() * f * n / 64)), 2) as p from hh, range(2, 31) t(f) group by block, ifo, f),
sn as (select block, sqrt(sum(4 * p / psd / 4096)) as snr from hf join psd using (ifo, f) group by block),
pn as (select *, row_number() over (order by block) as a, row_number() over (order by md5(block::varchar || '|snr'), block) as b from sn),
tg as materialized (select x.block, x.snr, y.snr as target from pn x join pn y on x.a = y.b)
"""


def _noise(v: Views):
    psd = signal.welch(v.win, "ifo", "samples", 64, 64.0)
    return fixed(psd.withColumn("bin", col("bin").cast("int")), "psd")  # a row per detector and bin


def _targets(v: Views, windows, floor=None):
    snrs = signal.network_snr(windows, _noise(v), ["block"], "ifo", "samples", 2, 30, 1 / 4096)
    return signal.target_snrs(fixed(snrs, "snrs"), "block", "snr", floor)


@query("rescale_snr", _NOISE + """
, hh as (select block, ifo, k - 1 as n, samples[k]::double as v from (select *, unnest(range(1, 65)) as k from win)),
""" + _SNRS + """
select block, ifo, round(target, 5) as target, round(greatest(least(snr, 1000), 12), 5) as clamped, round(samples[1]::double * target / snr, 6) as first from win join tg using (block)
""")
def rescale_snr(v: Views):
    """Every block's signal, in both detectors, gets the network SNR of another one; or its own, but 12 at least."""
    x = v.win.select("block", "ifo", F.transform("samples", lambda s: s.cast("double")).alias("samples"))
    scaled = signal.rescaled(x, _targets(v, x), ["block"], "samples")
    return scaled.select("block", "ifo", r(col("target"), 5).alias("target"), r(signal.clamped(col("snr"), 12.0), 5).alias("clamped"), r(col("samples")[0]).alias("first"))


@query("sample_snr", f"select event_id, round(pow(pow(lo, -2) + u * (pow(100, -2) - pow(lo, -2)), -0.5), 6) as snr from (select event_id, greatest(12 - 8 * (event_id % 100) / 80.0, 4) as lo, {_U.format(chr(101) + 'vent_id::varchar || ' + repr('|snr|1'))} as u from ev)")
def sample_snr(v: Views):
    """A power law whose lower end falls with the step."""
    lo = F.greatest(12 - 8 * (col("event_id") % 100) / 80.0, F.lit(4.0))
    u = sampling.uniform(col("event_id"), "snr", "1")
    return v.ev.select("event_id", r(F.pow(F.pow(lo, F.lit(-2)) + u * (100.0**-2 - F.pow(lo, F.lit(-2))), F.lit(-0.5))).alias("snr"))


def _pol(v: Views):
    return v.win.groupBy("block").agg(F.max(F.when(col("ifo") == "H1", col("samples"))).alias("plus"), F.max(F.when(col("ifo") == "L1", col("samples"))).alias("cross"))


#: Where each block's signal comes from, and samples per second; all detectors wait for the last by some samples.
_SKY = {"ra": "block * 0.37e0", "dec": "asin((block * 61 % 200) / 100.0e0 - 1)", "psi": "block * 0.13e0"}
_RATE, _AHEAD = 256.0, 6
_SKY_SQL = ", ".join(f"{e} as {n}" for n, e in _SKY.items())
_DET_SQL = " union all ".join(
    "select block, '{d}' as det, {0} as fp, {1} as fc, {ahead} + floor(({2}) * {rate} + 0.5)::bigint as delay from sky".format(*(e for e in (*detectors.antenna(d), detectors.delay(d))), d=d, ahead=_AHEAD, rate=_RATE)
    for d in detectors.RESPONSE
)


@query("project_detectors", f"""
, sky as (select block, {_SKY_SQL} from (select distinct block from win)), det as ({_DET_SQL})
select a.block, det, k, round(case when k > delay then fp * a.samples[k - delay]::double + fc * b.samples[k - delay]::double else 0 end, 6) as h
from win a join win b on a.block = b.block and a.ifo = 'H1' and b.ifo = 'L1' join det on det.block = a.block, range(1, 65) t(k)
""")
def project_detectors(v: Views):
    """Each block's two polarisations as every detector sees them from the block's place in the sky."""
    sky = _pol(v).withColumns({n: F.expr(e.replace("e0", "D")) for n, e in _SKY.items()})
    each = [
        F.struct(F.lit(d).alias("det"), F.expr(fp).alias("fp"), F.expr(fc).alias("fc"), (F.floor(F.expr(detectors.delay(d)) * _RATE + 0.5) + _AHEAD).cast("int").alias("delay"))
        for d in detectors.RESPONSE for fp, fc in [detectors.antenna(d)]
    ]
    h = sky.select("block", "plus", "cross", F.inline(F.array(*each))).withColumn("h", signal.project(col("plus"), col("cross"), col("fp"), col("fc"), col("delay")))
    return h.select("block", "det", F.posexplode("h").alias("k", "x")).select("block", "det", (col("k") + 1).cast("long").alias("k"), r(col("x")).alias("h"))


@query("slice_pad", "select block, ifo, k, case when pos + k - 9 between 0 and 63 then round(samples[pos + k - 8]::double, 6) else 0 end as x from (select *, block % 64 as pos from win), range(1, 21) t(k)")
def slice_pad(v: Views):
    cut = v.win.withColumn("s", signal.slice_pad(col("samples"), (col("block") % 64).cast("int"), 8, 12))
    return cut.select("block", "ifo", F.posexplode("s").alias("k", "x")).select("block", "ifo", (col("k") + 1).cast("long").alias("k"), r(col("x")).alias("x"))


@query("align_waveform", "select block, ifo, k, round(samples[(k + 16 + (block % 64 - 56 + 64)) % 64 + 1]::double, 6) as x from win, range(0, 48) t(k)")
def align_waveform(v: Views):
    a = v.win.withColumn("s", signal.align(col("samples"), 48, (col("block") % 64).cast("int"), 8))
    return a.select("block", "ifo", F.posexplode("s").alias("k", "x")).select("block", "ifo", col("k").cast("long").alias("k"), r(col("x")).alias("x"))


@query("random_kernel", f"select block, ifo, floor({_U.format('block::varchar || ' + repr('|kernel'))} * 33)::bigint as start, round(samples[floor({_U.format('block::varchar || ' + repr('|kernel'))} * 33)::bigint + 1]::double, 6) as first from win")
def random_kernel(v: Views):
    start = F.floor(sampling.uniform(col("block"), "kernel") * 33).cast("int")
    cut = signal.kernels(v.win, "samples", 32, start)
    return cut.select("block", "ifo", start.cast("long").alias("start"), r(col("kernel")[0].cast("double")).alias("first"))


@query("make_views", "select block, view, k, round(b::double + case when k - view * 4 between 1 and 64 then s else 0 end::double, 6) as x from (select a.block, view, k, a.samples[k] as b, c.samples[k - view * 4] as s from win a join win c on a.block = c.block and a.ifo = 'H1' and c.ifo = 'L1', range(0, 4) t(view), range(13, 65) u(k))")
def make_views(v: Views):
    """Shifted copies of each signal, added to its background."""
    many = _pol(v).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(3))))
    moved = F.slice(F.concat(F.array_repeat(F.lit(0.0), col("view") * 4), F.transform("cross", lambda x: x.cast("double"))), 1, 64)
    sums = F.zip_with("plus", moved, lambda a, b: a.cast("double") + b)
    return many.select("block", col("view").cast("long").alias("view"), F.posexplode(sums).alias("k", "x")).where("k >= 12").select("block", "view", (col("k") + 1).cast("long").alias("k"), r(col("x")).alias("x"))


@query("stack_channels", "select block, list(ifo order by ifo) as ifos, round(list(samples order by ifo)[1][1]::double, 6) as h1, round(list(samples order by ifo)[2][64]::double, 6) as l1 from win group by block")
def stack_channels(v: Views):
    s = v.win.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("ifo", "samples"))).alias("s"))  # a row per detector
    return s.select("block", col("s.ifo").alias("ifos"), r(col("s.samples")[0][0].cast("double")).alias("h1"), r(col("s.samples")[1][63].cast("double")).alias("l1"))


@query("score_windows", _WHITE + """
, sc as (select kind, ifo, block, sum(y * sin(n / 5.0)) as y from hy group by kind, ifo, block)
select ifo, block, round(any_value(y) filter (kind = 'background'), 4) as background, round(any_value(y) filter (kind = 'injected'), 4) as injected from sc group by ifo, block
""")
def score_windows(v: Views):
    """The scores of each whitened block without and with the signals in it."""
    import math

    scored = signal.score_windows(whitened(v), "white", template=[math.sin(n / 5.0) for n in range(64)])
    pairs = signal.paired(scored, ["ifo", "block"], "kind", ["background", "injected"], "score")
    return pairs.select("ifo", "block", *(r(col(k), 4).alias(k) for k in ("background", "injected")))


@query("build_training_set", _NOISE + """
, n as (select block, row_number() over (order by md5(block::varchar || '|role'), block) - 1 as k from (select distinct block from win)),
m as (select floor(count(*) * 0.1 / 2)::bigint as half, floor(count(*) * 0.1)::bigint as quiet, floor(count(*) * (0.3 + 0.1 + 0.1))::bigint as chosen from n),
ro as materialized (select block, k, case when k < half then k + half when k < 2 * half then k - half end as other,
  case when k < 2 * half then 'swapped' when k < 2 * half + quiet then 'muted' when k < chosen then 'signal' else 'background' end as role, case when k < half then k when k < 2 * half then k - half end as pair from n, m),
hh as materialized (select ro.block, i.ifo, t.n, i.a * p.samples[t.n + 1]::double + i.b * c.samples[t.n + 1]::double as v from ro join win p on p.block = ro.block and p.ifo = 'H1' join win c on c.block = ro.block and c.ifo = 'L1', (values ('H1', 0.6, 0.3), ('L1', -0.4, 0.5)) i(ifo, a, b), range(0, 64) t(n) where role <> 'background'),
""" + _SNRS + """
, sc as (select block, ifo, n, v * greatest(least(target, 1000), 12) / snr as v from hh join tg using (block)),
ch as (select ro.*, case when ('0x' || substr(md5(coalesce(l.block, ro.block)::varchar || '|channel'), 1, 12))::bigint % 2 = 0 then 'H1' else 'L1' end as channel from ro left join ro l on l.k = ro.pair and ro.pair is not null),
kn as (select ch.block, s.ifo, s.n, case when ch.role = 'muted' and s.ifo = ch.channel then 0 when ch.role = 'swapped' and s.ifo = ch.channel then o.v else s.v end as v
  from ch join sc s on s.block = ch.block left join ch h on h.k = ch.other left join sc o on o.block = h.block and o.ifo = s.ifo and o.n = s.n)
select w.block, w.ifo, role, (role = 'signal')::int as label, round(sum(pow(w.samples[t.n + 1]::double + coalesce(kn.v, 0), 2)), 4) as energy, round(any_value(w.samples[9]::double + coalesce(kn.v, 0)) filter (t.n = 8), 6) as x
from win w join ro using (block) cross join range(0, 64) t(n) left join kn on kn.block = w.block and kn.ifo = w.ifo and kn.n = t.n group by w.block, w.ifo, role
""")
def build_training_set(v: Views):
    """Background windows with projected and rescaled signals in exactly half of them; those with one channel swapped or muted count as background."""
    who = fixed(signal.roles(v.win, "block", "role", 0.3, 0.1, 0.1), "roles")
    pol = _pol(v).join(who.where("role != 'background'").select("block"), "block")
    see = lambda a, b: signal.project(col("plus"), col("cross"), F.lit(a), F.lit(b), F.lit(0))
    seen = pol.select("block", F.inline(F.array(*(F.struct(F.lit(i).alias("ifo"), see(a, b).alias("samples")) for i, a, b in (("H1", 0.6, 0.3), ("L1", -0.4, 0.5))))))
    scaled = signal.rescaled(seen, _targets(v, seen, floor=12.0), ["block"], "samples").select("block", "ifo", "samples")
    # of two partners the first says which channel they exchange
    first = F.when((col("role") == "swapped") & (col("place") >= col("half")), col("partner")).otherwise(col("block"))
    half = F.broadcast(who.agg((F.count_if(col("role") == "swapped") / 2).alias("half")))
    chosen = who.withColumnRenamed("k", "place").join(half).withColumn("channel", F.when(sampling.hashed(first, "channel") % 2 == 0, "H1").otherwise("L1")).select("block", "role", "partner", "channel")
    here = scaled.join(chosen, "block").withColumn("touched", col("ifo") == col("channel"))
    theirs = scaled.select(col("block").alias("partner"), "ifo", col("samples").alias("theirs"))
    kernels = here.join(theirs, ["partner", "ifo"], "left")
    kernel = F.when(col("touched") & (col("role") == "muted"), F.transform("samples", lambda x: x * 0)).when(col("touched") & (col("role") == "swapped"), col("theirs")).otherwise(col("samples"))
    rows = v.win.select("block", "ifo", F.transform("samples", lambda x: x.cast("double")).alias("noise")).join(who.select("block", "role"), "block")
    rows = rows.join(kernels.select("block", "ifo", kernel.alias("kernel")), ["block", "ifo"], "left")
    made = F.when(col("kernel").isNull(), col("noise")).otherwise(F.zip_with("noise", "kernel", lambda a, b: a + b))
    rows = rows.withColumn("made", made)
    return rows.select("block", "ifo", "role", (col("role") == "signal").cast("int").alias("label"), r(signal.dot(col("made"), col("made")), 4).alias("energy"), r(col("made")[8]).alias("x"))
