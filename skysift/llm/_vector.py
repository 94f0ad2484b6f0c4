"""Vectorised words and hashes over Arrow batches of texts (numpy inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier, for hashes of runs of words.
BASE = 0x9E3779B97F4A7C15

UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.frombuffer(UPPER_TO_LOWER, np.uint8)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BLOCK = 1 << 17
#: Random numbers of a byte in the first places of a word.
_BY_PLACE = mix(np.arange(64 << 8, dtype=U64) + U64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & (1 << 64) - 1, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and its n+1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return what arrays of a batch left free to the machine: workers live on beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: What a worker remembers between tasks, by operator: how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[name] = forget


def forget_others(*names: str) -> None:
    """Forget what tasks of other operators left in this worker, which lives on from stage to stage."""
    others = [k for k in _REMEMBERED if k not in names]
    for k in others:
        _REMEMBERED.pop(k)()
    if others:
        give_back()


def keep_freed() -> None:
    """Let this worker's allocator keep what arrays free for those that come next, up to ``give_back``: else a loop over small batches faults the same pages in again and again."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if tune is not None:
        tune(-3, 1 << 30)  # arrays below this come from the heap
        tune(-1, 1 << 30)  # whose top is not returned below this


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone. Memory is given back when all are done."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi
    if n > 0:
        give_back()


def word_spans(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't ``white``.

    Runs end where a row ends, whatever stands next to them.
    """
    inside = ~white[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the runs in ascending order and apart; ``lower`` folds A-Z first.

    The sum of a random number per byte and its place in the run, mixed with the length.
    """
    if not len(starts):
        return np.zeros(0, U64)
    total, last = np.zeros(len(raw) + 1, U64), 0
    for i in range(0, len(raw), _BLOCK):  # little memory beside the sums
        part = raw[i : i + _BLOCK]
        place = np.zeros(len(part), np.int64)
        here = starts[np.searchsorted(starts, i) : np.searchsorted(starts, i + _BLOCK)]
        place[here - i] = here
        np.maximum.accumulate(np.maximum(place, last, out=place), out=place)
        last = int(place[-1])
        np.subtract(np.arange(i, i + len(part)), place, out=place)
        far = int(place.max()) >= len(_BY_PLACE) >> 8
        place <<= 8
        place |= _LOWER[part] if lower else part
        b = _BY_PLACE.take(place, mode="clip")
        if far:
            late = place >= len(_BY_PLACE)
            b[late] = mix(place[late].astype(U64) + U64(BASE))
        b[:1] += total[i : i + 1]
        np.cumsum(b, out=total[i + 1 : i + 1 + len(part)])
    return mix(total[ends] - total[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def lists_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from values laid end to end."""
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


class HashIndex:
    """Open addressing over unique 64-bit keys; finds and adds arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys.astype(U64), return_index=True)
        self.n = 0
        self._make(len(keys), np.asarray(values).dtype)
        self.add(keys, np.asarray(values)[first])

    def _make(self, n: int, dtype: np.dtype) -> None:
        self.bits = max(4, int(2 * n + 1).bit_length())
        size = 1 << self.bits
        self.mask = size - 1
        self.key, self.used, self.value = np.zeros(size, U64), np.zeros(size, bool), np.zeros(size, dtype)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` are distinct and new."""
        self.n += len(keys)
        if 2 * self.n > self.mask:
            old = self.key[self.used], self.value[self.used]
            self._make(2 * self.n, self.value.dtype)
            self._put(*old)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = ~self.used[at]
            slot, who = at[free], left[free]
            slot, take = np.unique(slot, return_index=True)
            self.key[slot], self.value[slot], self.used[slot] = keys[who[take]], values[who[take]], True
            lost = ~(self.used[at] & (self.key[at] == keys[left]))
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(BASE)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, missing=-1) -> np.ndarray:
        out = np.full(len(keys), missing, self.value.dtype)
        at, left = self._home(keys), None
        while len(at):
            used, same = self.used[at], self.key[at] == (keys if left is None else keys[left])
            hit = np.flatnonzero(used & same)
            out[hit if left is None else left[hit]] = self.value[at[hit]]
            go = np.flatnonzero(used & ~same)
            left, at = go if left is None else left[go], (at[go] + 1) & self.mask
        return out
