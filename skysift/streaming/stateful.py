"""Stateful operators of the live search on Spark's state store: what a block changes is what is written.

A processor keeps, per detector, a value of fixed size and, block by block, what it must remember:
in a map by the block's number, from which the oldest goes as a new one comes, or in a list that
only grows until it is emptied. So a block costs its own size in the state store, not the
buffer's. Timers in event time tell when a detector has been silent for too long, and end its state.

Rows of a micro-batch are sorted before they meet the state; a block that comes after a newer one
of its detector is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .live import LATENESS

class Processor(StatefulProcessor):
    """Per detector: subclasses say what the value of fixed size is, what a block does, and what a silence of ``wait`` does."""

    #: The value's DDL, what it begins with, and the output's DDL; the value's first field is the last block's number.
    value, begin, output = "last long", (-1,), "ifo long, i long"
    #: The columns of the input beside ifo, i and ts that ``block`` gets.
    inputs = ("y", "ready")

    def __init__(self, wait: str | None = None):
        self.wait = wait

    def init(self, handle: Any) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", self.value)

    def block(self, now: list, i: int, *values: Any) -> Iterator[tuple]:
        raise NotImplementedError

    def silence(self, now: list) -> Iterator[tuple]:
        """What is told when a detector falls silent; its state ends then."""
        return iter(())

    def forget(self) -> None:
        self.kept.clear()

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in rows], columns=[f.split()[0] for f in self.output.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = list(self.kept.get()) if self.kept.exists() else list(self.begin)
        part, out = pd.concat(rows).sort_values("i", kind="stable"), []
        for i, *values in zip(part["i"].tolist(), *(part[c].tolist() for c in self.inputs)):
            if i > now[0]:
                out += self.block(now, i, *values)
                now[0] = i
        self.kept.update(tuple(now))
        if self.wait:
            newest = part["ts"].max()
            newest = newest.tz_localize("UTC") if newest.tzinfo is None else newest
            until = max(int(newest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + pd.Timedelta(self.wait) // pd.Timedelta("1ms")
            for old in list(self.handle.listTimers()):
                until = max(until, old)
                self.handle.deleteTimer(old)
            self.handle.registerTimer(until)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = list(self.silence(list(self.kept.get()))) if self.kept.exists() else []
        self.forget()
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def apply(self, stream: DataFrame) -> DataFrame:
        return stream.withWatermark("ts", LATENESS).groupBy("ifo").transformWithStateInPandas(self, self.output, "append", "EventTime")


class Rolling(Processor):
    """The last ``size`` blocks; ready once as many came without a gap and all ready.

    Blocks are held in a map by number; a gap, a block that isn't ready, or a silence empties it.
    """

    value, begin, output = "last long, filled int, total double", (-1, 0, 0.0), "ifo long, i long, filled int, full boolean, total double"

    def __init__(self, size: int, wait: str | None = None):
        super().__init__(wait)
        self.size = size

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "i long", "y double")

    def forget(self) -> None:
        super().forget()
        self.held.clear()

    def block(self, now, i, y, ready):
        if not ready or i != now[0] + 1:
            if now[1]:
                self.held.clear()
            now[1], now[2] = 0, 0.0
        if ready:
            if now[1] == self.size:
                now[2] -= self.held.getValue((i - self.size,))[0]
                self.held.removeKey((i - self.size,))
                now[1] -= 1
            self.held.updateValue((i,), (y,))
            now[1] += 1
            now[2] += y
        yield i, now[1], now[1] == self.size, now[2]


class Detect(Processor):
    """Events from frames of ``frame`` blocks with two scores: ``sig``, which an event's loudness is read from, and ``y``, whose peak times it.

    A frame whose largest ``sig`` reaches the threshold makes an event at the peak of ``y``, unless that is its
    last block: then the score may still rise, and the next frame, which begins with that block, decides. After an event others are
    suppressed for ``period`` blocks, and detecting ends then, too. Losing readiness while detecting, by a block that
    isn't ready or by silence, makes the event at the last block, with its ``sig``.
    """

    value, begin = "last long, first long, n int, detecting boolean, event long", (-1, 0, 0, False, -(10**9))
    output, inputs = "ifo long, i long, y double, partial boolean", ("y", "sig", "ready")

    def __init__(self, threshold: float, frame: int, period: int, wait: str | None = None):
        super().__init__(wait)
        self.threshold, self.frame, self.period = threshold, frame, period

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.buffer = handle.getListState("buffer", "y double, sig double")

    def forget(self) -> None:
        super().forget()
        self.buffer.clear()

    def _event(self, now: list, i: int, y: float, partial: bool) -> Iterator[tuple]:
        now[3] = False
        if i - now[4] >= self.period:
            now[4] = i
            yield i, float(y), partial

    def _flush(self, now: list) -> Iterator[tuple]:
        if now[3] and now[2]:
            yield from self._event(now, now[1] + now[2] - 1, [s for _, s in self.buffer.get()][-1], True)
        if now[2]:
            self.buffer.clear()
        now[2], now[3] = 0, False

    def silence(self, now):
        yield from self._flush(now)

    def block(self, now, i, y, sig, ready):
        if not ready:
            yield from self._flush(now)
            return
        if now[2] and i != now[1] + now[2]:
            self.buffer.clear()
            now[2] = 0
        if not now[2]:
            now[1] = i
        self.buffer.appendValue((y, sig))
        now[2] += 1
        if now[2] < self.frame:
            return
        held = list(self.buffer.get())
        if max(s for _, s in held) >= self.threshold:
            top = max(range(self.frame), key=lambda k: held[k][0])
            if top < self.frame - 1:
                yield from self._event(now, now[1] + top, max(s for _, s in held), False)
            else:
                now[3] = True
        self.buffer.clear()
        now[2] = 0
        if now[3]:
            self.buffer.appendValue(held[-1])
            now[1], now[2] = i, 1
