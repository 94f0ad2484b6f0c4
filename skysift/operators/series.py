"""Score series and peaks: trailing means, clusters, windows, pools, refractory periods, budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import fixed


def boxcar(df: DataFrame, width: int, by: Sequence[str], order: str = "i", value: str = "y", length: int = 1 << 16) -> DataFrame:
    """Trailing mean over ``width`` samples with zeros before the start and for missing ones; a width of 1 changes nothing.

    ``order`` numbers the samples. A series is cut into ranges, each with the tail of the one before beside it.
    """
    length = max(length, width)
    k = F.floor(F.col(order) / length).cast("long")
    tails = F.when(F.col(order) - k * length > length - width, F.array(k, k + 1)).otherwise(F.array(k))
    rows = df.withColumn("_range", F.explode(tails)).withColumn("_own", F.col("_range") == k)
    w = Window.partitionBy(*by, "_range").orderBy(order).rangeBetween(-(width - 1), 0)
    return rows.withColumn("_mean", F.sum(value).over(w) / width).where("_own").select(*(F.col("_mean").alias(c) if c == value else F.col(c) for c in df.columns))


def drop_burn_in(df: DataFrame, offset: int, order: str = "i") -> DataFrame:
    return df.where(F.col(order) >= offset).withColumn(order, F.col(order) - offset)


def clock(t0: float, psd_length: float, fduration: float, integration: float) -> float:
    """The time of the first sample after the burn-in."""
    return t0 + psd_length - fduration / 2 - integration


def _ranged(df: DataFrame, by: Sequence[str], place: Column, length: float, halo: float) -> DataFrame:
    """Rows by range of their place, with the head of the next range beside each range's own (``_own`` is false there)."""
    k = F.floor(place / length).cast("long")
    heads = F.when(place - k * length < halo, F.array(k, k - 1)).otherwise(F.array(k))
    return df.withColumn("_range", F.explode(heads)).withColumn("_own", F.col("_range") == k)


def _entries(exits: DataFrame, by: Sequence[str], follow: Callable[[pd.DataFrame], list]) -> DataFrame:
    """(by, _range, _entry): where a walk enters each range, from what each range makes of every possible entry (a row per range)."""
    kinds = ", ".join(f"{c} {exits.schema[c].dataType.simpleString()}" for c in by)

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_range", ignore_index=True)
        return part[[*by, "_range"]].assign(_entry=np.array(follow(part), np.float64))

    return exits.groupBy(*by).applyInPandas(chain, f"{kinds}, _range long, _entry double")


def _successors(y: np.ndarray, half: int) -> np.ndarray:
    """For every sample the first largest of the ``half`` after it if that is larger, else the sample past those."""
    n = len(y)
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate((y[1:], np.full(half, -np.inf))), half)
    first = np.concatenate([x.argmax(1) for x in np.array_split(ahead, max(1, n * half >> 22))])
    at = np.arange(n)
    return np.where(ahead[at, first] > y, at + 1 + first, at + half + 1)


def cluster_peaks(df: DataFrame, window: int, by: Sequence[str], order: str = "i", value: str = "y", length: int = 1 << 16) -> DataFrame:
    """(by, order, value) of each series' greedy peaks: samples that none of the next ``window // 2`` exceeds, each reached from
    the one before by way of larger and larger samples, beginning at the largest of the first ``window // 2``.

    ``order`` numbers the samples; missing ones and null values are lower than all others and never are peaks. A series is cut into ranges: every sample's successor is
    known from its range and the head of the next, so a range can tell for each of the few places at which a
    walk may enter where it leaves. Only those short lists are followed one after the other; then ranges are walked side by side.
    """
    half, rows = max(window // 2, 1), df.select(*by, order, value).where(F.col(order).isNotNull())
    parts = _ranged(rows, by, F.col(order), length, half)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def successors(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        y = np.full(length + half, -np.inf)
        x = part[value].to_numpy(np.float64)
        y[part[order].to_numpy(np.int64) - int(part["_range"].iloc[0]) * length] = np.where(np.isnan(x), -np.inf, x)
        return y, _successors(y, half)[:length]

    def leave(part: pd.DataFrame) -> pd.DataFrame:
        y, to = successors(part)
        jump = np.concatenate((to, np.arange(length, length + half + 1)))
        while (jump[:length] < length).any():  # twice as far each time
            jump = jump[jump]
        own = part.loc[part["_own"], order]
        begin = int(own.min()) - int(part["_range"].iloc[0]) * length if len(own) else 0
        begin += int(y[begin : begin + half].argmax())
        exits = [int(jump[begin]) - length, *(jump[: half + 1] - length).tolist()]
        return part.iloc[:1][[*by, "_range"]].assign(some=bool(len(own)), begin=begin, exits=[exits])

    def follow(part: pd.DataFrame) -> list:
        out, at, before = [], 0, None
        for k, some, begin, exits in zip(part["_range"].tolist(), part["some"].tolist(), part["begin"].tolist(), part["exits"].tolist()):
            if before is None:  # the series begins with its first samples
                out.append(begin)
                at, before = (int(exits[0]), k) if some else (0, None)
                continue
            empty = (k - before - 1) * length  # ranges without samples are walked in whole steps
            at += max(0, -(-(empty - at) // (half + 1))) * (half + 1) - empty
            out.append(at)
            at, before = int(exits[1 + at]), k
        return out

    exits = parts.groupBy(*by, "_range").applyInPandas(leave, f"{kinds}, _range long, some boolean, begin long, exits array<long>")
    names = [c for c in df.columns if c in (*by, order, value)]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        y, to = successors(part)
        at, peaks = int(part["_entry"].iloc[0]), []
        while at < length:
            if to[at] == at + half + 1:
                peaks.append(at)
            at = int(to[at])
        here = part["_own"].to_numpy() & np.isin(part[order].to_numpy(np.int64) - int(part["_range"].iloc[0]) * length, peaks)
        return part[here & part[value].notna().to_numpy()][names]

    entered = parts.join(_entries(fixed(exits, "exits"), by, follow), [*by, "_range"])
    out = entered.groupBy(*by, "_range").applyInPandas(walk, df.select(*names).schema)
    return out.select(*by, order, value)


def refractory(df: DataFrame, by: Sequence[str], time: str, period: float, length: float | None = None) -> DataFrame:
    """Detections of each run at least ``period`` after the last one that was kept.

    Runs are cut into ranges of time, longer than a period: a range tells for each detection that could be its first kept one which
    one is its last, those lists are followed one after the other, and then ranges are walked side by side. Rows without a time go.
    """
    length = max(length or 256 * period, 2 * period)
    rows = df.where(F.col(time).isNotNull()).withColumn("_range", F.floor(F.col(time) / length).cast("long"))
    kinds, names = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), df.columns

    def last_kept(part: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(part[time].to_numpy(np.float64))
        to = np.append(np.searchsorted(t, t + period), len(t))
        last = np.where(to[:-1] == len(t), np.arange(len(t)), to[:-1])
        while (last[last] != last).any():
            last = last[last]
        # the last one before the range lets one of these in, or the first after them
        may = int(np.searchsorted(t, int(part["_range"].iloc[0]) * length + period)) + 1
        return part.iloc[:1][[*by, "_range"]].assign(first=[t[:may].tolist()], last=[t[last][:may].tolist()])

    def follow(part: pd.DataFrame) -> list:
        out, free = [], -np.inf
        for first, last in zip(part["first"].tolist(), part["last"].tolist()):
            out.append(free)
            k = int(np.searchsorted(np.asarray(first), free))
            free = last[k] + period if k < len(last) else free
        return out

    lists = rows.groupBy(*by, "_range").applyInPandas(last_kept, f"{kinds}, _range long, first array<double>, last array<double>")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time, kind="stable")
        t = part[time].to_numpy(np.float64)
        to, kept = np.searchsorted(t, t + period), []
        at = int(np.searchsorted(t, part["_entry"].iloc[0]))
        while at < len(t):
            kept.append(at)
            at = int(to[at])
        return part.iloc[kept][names]

    entered = rows.join(_entries(fixed(lists, "lists"), by, follow), [*by, "_range"])
    return entered.groupBy(*by, "_range").applyInPandas(walk, df.schema)


def unfold(samples: Column, size: int, stride: int) -> Column:
    """All whole windows of ``size`` samples, ``stride`` apart, as an array of arrays."""
    last = F.floor((F.size(samples) - size) / stride).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(samples, k * stride + 1, size))).otherwise(F.array())


def max_pool(df: DataFrame, size: int, by: Sequence[str], order: str = "i", value: str = "y") -> DataFrame:
    """(by, w, value): maxima over windows of ``size``, half of that apart, a last partial one included.

    A row goes to the at most three windows that it lies in.
    """
    stride = max(size // 2, 1)
    n = df.groupBy(*by).agg((F.max(order) + 1).alias("_n"))
    # windows start while there are samples beyond the whole ones
    count = F.when(F.col("_n") <= size, 1).otherwise(F.ceil((F.col("_n") - size) / stride) + 1)
    k = F.col(order)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((k - size + 1) / stride).cast("long"))
    rows = df.join(n, list(by)).withColumn("w", F.explode(F.sequence(first, F.floor(k / stride).cast("long")))).where(F.col("w") < count)
    return rows.groupBy(*by, "w").agg(F.max(value).alias(value))


def livetime(df: DataFrame, events: dict[str, str], by: Sequence[str], time: str, kind: str, then: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """Live seconds per group: open from the first line, closed by some kinds, reopened by another, until the last line.

    ``events`` maps kinds to ``close`` or ``open``; ``then`` orders simultaneous lines. Ranges of ``width`` seconds are worked side by side.
    """
    from .matching import earlier

    step = F.when(F.col(kind).isin(*(k for k, s in events.items() if s == "close")), 0).when(F.col(kind).isin(*(k for k, s in events.items() if s == "open")), 1)
    rows = earlier(df, by, time, {"_before": step, "_last": F.col(time)}, width, then)
    live = F.when(F.coalesce("_before", F.lit(1)) == 1, F.coalesce(F.col(time) - F.col("_last"), F.lit(0.0))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.sum(live).alias("live"))


def last_state(df: DataFrame, ready: str, failed: str, by: Sequence[str], time: str, kind: str) -> DataFrame:
    """Whether each group is ready, by its last line of either kind; without one it is."""
    state = F.when(F.col(kind) == ready, True).when(F.col(kind) == failed, False)
    return df.groupBy(*by).agg(F.coalesce(F.max_by(state, F.when(state.isNotNull(), F.col(time))), F.lit(True)).alias("ready"))


def auroc(df: DataFrame, score: str, label: str, max_fpr: float = 1.0) -> DataFrame:
    """Area under the ROC curve up to a false positive rate, over that rate; ties of scores are one step."""
    from .ranks import running

    steps = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    total = steps.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    steps = running(steps, score, {"tp": "p", "fp": "n"}).join(F.broadcast(total))
    x1, x0 = F.col("fp") / F.col("all_n"), (F.col("fp") - F.col("n")) / F.col("all_n")
    y1, y0 = F.col("tp") / F.col("all_p"), (F.col("tp") - F.col("p")) / F.col("all_p")
    end = F.least(x1, F.lit(max_fpr))
    at_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    area = F.when(x0 < max_fpr, (end - x0) * (y0 + at_end) / 2).otherwise(0.0)
    return steps.agg((F.sum(area) / max_fpr).alias("auroc"))
