"""Constant-Q transforms of windows: planes of tiles with log-spaced frequencies.

A row of a plane is a frequency: the window's spectrum about it, under a bisquare whose width grows with
the frequency over Q, is turned back to time at as few points as the row's resolution needs. Squared sizes over
their row's median are the tiles' energies. Of several Q the plane with the loudest tile is taken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .signal import _rows

#: The most energy that a signal between two tiles may lose.
MISMATCH = 0.2
#: Cycles over 2 pi that the lowest frequency has at least in a window's duration, per Q.
CYCLES = 50.0


class Row(NamedTuple):
    """A plane's row: its frequency in bins of the spectrum, half its window's width in bins, and its number of tiles."""

    bin: int
    half: int
    tiles: int


def rows(q: float, n: int, rate: float, mismatch: float = MISMATCH, cycles: float = CYCLES) -> list[Row]:
    """The rows of a plane of ``n`` samples; none where no frequency fits."""
    duration, prime = n / rate, q / math.sqrt(11)
    low, high = cycles * q / (2 * math.pi * duration), rate / 2 / (1 + math.sqrt(11) / q)
    if not low < high or q < math.sqrt(11):
        return []
    step = 2 * math.sqrt(mismatch / 3)
    whole = math.log(high / low) * math.sqrt(2 + q * q) / 2
    count, out = max(1, math.ceil(whole / step)), []
    for i in range(count):
        f = low * math.exp(2 / math.sqrt(2 + q * q) * (i + 0.5) * whole / count)
        at = int(f * duration)  # whole cycles
        half = int(at / prime)
        if at and half:
            need = max(2 * math.pi * at / q / step, 2 * half + 1)
            out.append(Row(at, half, 1 << math.ceil(math.log2(need))))
    return out


def plane(x: np.ndarray, listed: Sequence[Row]) -> list[np.ndarray]:
    """Energies over their median, row by row of the plane, of each row of ``x``."""
    spectrum, out = np.fft.rfft(x, axis=1), []
    for at, half, tiles in listed:
        d = np.arange(-half, half + 1)
        turned = np.zeros((len(x), tiles), np.complex128)
        turned[:, d % tiles] = spectrum[:, at + d] * (1 - (d / half) ** 2) ** 2
        energy = np.abs(np.fft.ifft(turned, axis=1)) ** 2
        middle = np.median(energy, 1, keepdims=True)
        out.append(np.divide(energy, middle, out=np.zeros_like(energy), where=middle > 0))
    return out


def on_grid(energies: Sequence[np.ndarray], listed: Sequence[Row], height: int, width: int) -> np.ndarray:
    """A plane on an even grid of times and of logarithms of frequencies, by linear interpolation first in time, then in frequency."""
    times = (np.arange(width) + 0.5) / width
    lines = np.stack([np.interp(times * len(e), np.arange(len(e) + 1), np.append(e, e[0])) for e in energies])
    places = np.log([r.bin for r in listed])
    places, first = np.unique(places, return_index=True)  # low frequencies may share a bin
    asked = np.linspace(places[0], places[-1], height)
    return np.stack([np.interp(asked, places, column) for column in lines[first].T], 1)


def scan(samples: Column, qs: Sequence[float], rate: float, mismatch: float = MISMATCH, cycles: float = CYCLES, shape: tuple[int, int] | None = None) -> Column:
    """(q, tiles) of each window: the Q whose plane has the loudest tile, the first of equal ones, and that plane's rows, or its values on a grid of ``shape``."""

    @F.pandas_udf("q double, tiles array<array<double>>")
    def f(column: pd.Series) -> pd.DataFrame:
        def one(x: np.ndarray) -> list:
            known = [(q, listed, plane(x, listed)) for q in qs if (listed := rows(q, x.shape[1], rate, mismatch, cycles))]
            made = []
            for i in range(len(x)):
                if not known:
                    made.append((None, None))
                    continue
                q, listed, e = max(known, key=lambda k: max(r[i].max() for r in k[2]))
                mine = [r[i] for r in e]
                made.append((q, list(on_grid(mine, listed, *shape)) if shape else mine))
            return made

        got = [(None, None) if y is None or not len(y) else y for y in _rows(column, one)]
        return pd.DataFrame({"q": pd.Series([g[0] for g in got], dtype="float64"), "tiles": [g[1] for g in got]})

    return f(samples)
