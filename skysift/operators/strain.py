"""Sampled series in blocks: what crosses the borders of blocks, as joins on their numbers.

A series is a row per block: keys, the block's number and its samples. Blocks of a series have
one size, but the last may be shorter; a missing number is a gap. Nothing here orders a series
within a task: a block gets what it needs of others by equi-joins on keys and numbers, and sums are
made where the samples are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .series import unfold
from .signal import hann

#: Blocks that a task holds sums of before it sends them.
HELD = 2048


def _doubles(x: str | Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def beside(blocks: DataFrame, by: Sequence[str], order: str, samples: str, before: int = 0, after: int = 0) -> DataFrame:
    """``blocks`` with _before, the last samples of the block before, and _after, the first of the next; null where there is none.

    Each side has at most a block's samples.
    """
    out = blocks
    for name, n, step, cut in (("_before", before, 1, F.slice(samples, -F.least(F.size(samples), F.lit(before)), before)), ("_after", after, -1, F.slice(samples, 1, after))):
        if n:
            out = out.join(blocks.select(*by, (F.col(order) + step).alias(order), cut.alias(name)), [*by, order], "left")
    return out


def shifted(blocks: DataFrame, by: Sequence[str], order: str, samples: str, shift: int, size: int) -> DataFrame:
    """Each block's place with the samples ``shift`` later (any number, negative too): those of the block that place falls in, and of the next."""
    whole, part = shift // size, shift % size
    moved = blocks.withColumn(order, F.col(order) - whole)
    if not part:
        return moved
    here = moved.select(*by, order, F.slice(samples, part + 1, size).alias(samples))
    head = moved.select(*by, (F.col(order) - 1).alias(order), F.slice(samples, 1, part).alias("_head"))
    line = F.concat(samples, F.coalesce("_head", F.slice(samples, 1, 0)))
    return here.join(head, [*by, order], "left").select(*by, order, line.alias(samples))


def windows(blocks: DataFrame, by: Sequence[str], order: str, samples: str, size: int, stride: int, out: str = "window") -> DataFrame:
    """(by, order, k, out): all whole windows of a series, the k-th of those that begin in a block; a window goes on in the next block.

    A block's size is a multiple of ``stride``, and at least ``size - stride``.
    """
    rows = beside(blocks, by, order, samples, after=size - stride) if size > stride else blocks.withColumn("_after", F.lit(None))
    line = F.concat(samples, F.coalesce("_after", F.slice(samples, 1, 0))) if size > stride else F.col(samples)
    return rows.select(*by, order, F.posexplode(unfold(line, size, stride)).alias("k", out))


def add_signals(strain: DataFrame, signals: DataFrame, by: Sequence[str], order: str, samples: str, size: int, first: str = "first", wave: str = "wave") -> DataFrame:
    """``strain`` with signals added to its samples: each signal's ``wave`` from the sample numbered ``first`` on, in its key's series.

    A wave is cut over the blocks that it reaches, and what lies outside of the strain's blocks is left out. Tasks add up the pieces block by
    block in Arrow, so that of a block that many signals meet in a sum per task moves, and those are summed sample by sample.
    """
    x = signals.where(F.col(wave).isNotNull() & (F.size(wave) > 0) & F.col(first).isNotNull())
    last = F.col(first) + F.size(wave) - 1
    div = lambda c: F.floor(c / size).cast("long")
    pieces = x.select(*by, F.col(first).alias("_f"), _doubles(wave).alias("_w"), F.explode(F.sequence(div(F.col(first)), div(last))).alias(order))
    at = F.greatest(F.col("_f") - F.col(order) * size, F.lit(0)).cast("int")
    skip = F.greatest(F.col(order) * size - F.col("_f"), F.lit(0)).cast("int")
    pieces = pieces.select(*by, order, at.alias("_at"), F.slice("_w", skip + 1, F.lit(size) - at).alias("_w"))
    keys = [*by, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*held), kinds)]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * size), pa.array(np.concatenate(list(held.values()))))
            return pa.RecordBatch.from_arrays([*cols, sums], [*keys, "_sums"])

        for batch in batches:
            kinds = batch.schema.types[: len(keys)]
            flat, off = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(batch.column(len(keys) + 1).offsets.to_numpy())))).tolist()
            for i, (key, a) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in range(len(keys)))), batch.column(len(keys)).to_pylist())):
                total = held.get(key)
                if total is None:
                    if len(held) >= HELD:
                        yield flush()
                        held.clear()
                    total = held[key] = np.zeros(size)
                total[a : a + off[i + 1] - off[i]] += flat[off[i] : off[i + 1]]
        if held:
            yield flush()

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keys)
    sums = pieces.mapInArrow(run, f"{schema}, _sums array<double>").select(*keys, F.posexplode("_sums").alias("_k", "_v"))
    sums = sums.groupBy(*keys, "_k").agg(F.sum("_v").alias("_v")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_s"))  # ``size`` values
    both = strain.join(sums.select(*keys, F.col("_s._v").alias("_s")), keys, "left")
    added = F.zip_with(_doubles(samples), F.slice("_s", 1, F.size(samples)), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return both.withColumn(samples, F.when(F.col("_s").isNull(), _doubles(samples)).otherwise(added)).select(*strain.columns)


def _powers(frame: int, rate: float):
    """All frames' power densities of each block, half overlapping, Hann windowed."""
    from .signal import _rows

    @F.pandas_udf("array<array<double>>")
    def f(column: pd.Series) -> pd.Series:
        w = hann(frame)

        def one(x: np.ndarray) -> np.ndarray:
            starts = range(0, x.shape[1] - frame + 1, frame // 2)
            return np.stack([np.abs(np.fft.rfft(x[:, s : s + frame] * w, axis=1)) ** 2 for s in starts], 1) * 2 / (rate * (w * w).sum())

        return pd.Series([None if y is None else list(y) for y in _rows(column, one)])

    return f


def rolling_psd(blocks: DataFrame, by: Sequence[str], order: str, samples: str, frame: int, rate: float, history: int) -> DataFrame:
    """(by, order, psd): for each place the median, bin by bin, over the frames of the ``history`` blocks before it; without all of them it has none.

    Every block's frames go to the places that will use them; a place holds as many frames as ``history`` blocks have.
    """
    frames = blocks.select(*by, order, _powers(frame, rate)(F.col(samples)).alias("_p")).where("size(_p) > 0")
    sent = frames.select(*by, F.explode(F.sequence(F.col(order) + 1, F.col(order) + history)).alias(order), "_p")
    held = sent.groupBy(*by, order).agg(F.flatten(F.collect_list("_p")).alias("_p"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == history)

    @F.pandas_udf("array<double>")
    def median(column: pd.Series) -> pd.Series:
        return pd.Series([np.median(np.stack([np.asarray(p) for p in x]), 0) for x in column])

    return held.select(*by, order, median("_p").alias("psd"))


def whiten(rows: DataFrame, psd: DataFrame, by: Sequence[str], order: str, samples: str, rate: float, fduration: int, apart: Sequence[str] = (), out: str = "white") -> DataFrame:
    """``rows`` with their samples whitened by the density of their key and place, whatever they hold beside that (``apart`` tells series of one key apart, such as a background and the same with signals).

    The filter has ``fduration`` samples; half of that is borrowed from either neighbour, so blocks without both, or without a density, are left out.
    """
    half = fduration // 2
    long = beside(rows, [*apart, *by], order, samples, half, half).where(f"_before is not null and _after is not null and size(_before) = {half} and size(_after) = {half}")
    both = long.join(psd, [*by, order])

    @F.pandas_udf("array<double>")
    def f(column: pd.Series, densities: pd.Series) -> pd.Series:
        made = []
        for x, d in zip(column, densities):
            x, n = np.asarray(x, np.float64), len(x)
            d = np.interp(np.linspace(0, 1, n // 2 + 1), np.linspace(0, 1, len(d)), d)
            kernel, taper, shape = np.fft.irfft(1 / np.sqrt(np.maximum(d, 1e-30)), n), hann(2 * half), np.zeros(n)
            shape[:half], shape[n - half :] = taper[half:], taper[:half]
            y = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(kernel * shape), n) * np.sqrt(2 / rate)
            made.append(y[half : n - half])
        return pd.Series(made)

    line = F.concat(_doubles("_before"), _doubles(samples), _doubles("_after"))
    return both.withColumn(out, f(line, F.col("psd"))).select(*rows.columns, out)
