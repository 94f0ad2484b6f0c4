"""A gated recurrent language model that scores whole documents.

Counts. Tasks count words (64-bit hashes) of all training documents and a shuffle sums
them. The words whose counts fit the bound ``BROADCAST_WORDS`` are broadcast; documents
find the rarer ones by a join, each document sending only those words it couldn't resolve.

Model. The most frequent words and the end are units of their own; all others share units
by how they begin and end, and within such a unit a word has its smoothed share of the
unit's count, with one place for unknown words. So the model gives a proper
distribution over the words seen and the unknown one. A GRU reads the units; its output
softmax is factored into classes of units. Its first state of training, with output
weights of zero and biases from the counts, is the unigram model.

Training. All training documents take part, each in one of ROUNDS rounds. A round deals its
documents to tasks of about TASK_BYTES; each deals them to lanes of about one length and runs
truncated backpropagation with state carried from window to window, and the next round starts
from the mean of their weights.

Scoring. Texts are read twice, for the counts and as units; training and scoring read those.
Documents of pooled batches run side by side, in windows; the state is carried to the
document's end, which is scored as a token.

Defined results: null text counts as empty; an empty text has one token, the end; without
training documents all words are unknown; repeated rows get equal scores; null ids count
as the empty text for the fold; an id column called like a column of the result gets an
underscore behind its name; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _labels
from ._store import id_name, staged
from ._vector import U64, HashIndex, _LOWER, chunks, give_back, keep_freed, mix, text_bytes, word_hashes, word_spans

#: The bound of what is broadcast of the counts.
BROADCAST_WORDS = 1_000_000
#: Units: words of their own, and shared ones; classes of the output.
WORDS, SHARED = 768, 256
UNITS = WORDS + SHARED
CLASSES = 32
PER_CLASS = UNITS // CLASSES
HIDDEN = 24
ROUNDS = 2
LANES, WINDOW = 128, 24
#: Logits lie between this and its negative.
LIMIT = 60
#: Bytes of units (two per token) that one training task gets, about.
TASK_BYTES = 8 << 20
#: Lanes that are scored side by side, and bytes of units (two per token) of the documents that are dealt to them at once, about.
BESIDE, POOLED = 512, 8 << 20
#: Rows of a unit in a window up to which units are summed side by side.
FEW = 12
END = int(mix(np.array([0xE17D], U64))[0])
RATE = 2e-3


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shared unit (0 .. SHARED - 1) and row of every token, the end of each row included, in order."""
    starts, ends, rows = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    first = _LOWER[raw[starts]].astype(U64)
    second = np.where(ends - starts > 1, _LOWER[raw[np.minimum(starts + 1, max(0, len(raw) - 1))]], 0).astype(U64) if len(raw) else first
    last = raw[ends - 1]
    mark = ((last < 0x80) & ~((last >= 0x30) & (last < 0x3A)) & ~((last | 0x20) >= 0x61)).astype(U64) * last
    shared = (mix(first * U64(65536) + second * U64(256) + mark) % U64(SHARED)).astype(np.int64)
    n = len(offsets) - 1
    at = np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)  # where the ends go
    total = len(h) + n
    is_end = np.zeros(total, bool)
    is_end[at] = True
    out = [np.full(total, END, U64), np.zeros(total, np.int64), np.zeros(total, np.int64)]
    for o, values in zip(out, (h, shared, rows)):
        o[~is_end] = values
    out[2][at] = np.arange(n)
    return out[0], out[1], out[2]


def tokens_in_parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of many rows, hashed in parts of bounded size: hashing takes some 40 bytes per byte of text."""
    parts = []
    for lo, hi in chunks(offsets, 1 << 20):
        h, shared, rows = tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts.append((h, shared.astype(np.int16), rows.astype(np.int32) + lo))
    return tuple(np.concatenate(x) for x in zip(*parts))


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, shared, n) over all ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, n = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h, kind="stable")
            h, s, n = h[by], s[by], n[by]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[first], s[first], np.add.reduceat(n, first)

        def batch_of(h, s, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["word", "shared", "n"])

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for lo, hi in chunks(offsets):
                h, s, _ = tokens_in_parts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                by = np.argsort(h)  # which of equal words comes first doesn't matter
                h = h[by]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                h, n = h[first], np.diff(np.append(first, len(h)))
                held.append((h, s[by[first]], n))
                size += len(h)
                if size > 1_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 600_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            h, s, n = merged()
            for k in range(0, len(h), 200_000):
                yield batch_of(h[k : k + 200_000], s[k : k + 200_000], n[k : k + 200_000])

    part = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "word long, shared int, n long")
    return staged(part.groupBy("word").agg(F.min("shared").alias("shared"), F.sum("n").alias("n")), "counts")


class Vocabulary:
    """Counts of the broadcast words, units of all words, and what a word has of its shared unit."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.tokens, self.types = total[0] or 0, total[1]
        kept, self.least = 0, 1
        by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("types")).orderBy(F.desc("n"))
        for r in by_count.toLocalIterator():
            if kept + r.types > BROADCAST_WORDS:
                self.least = r.n + 1
                break
            kept += r.types
        known = counts.where(F.col("n") >= self.least).select("word", "n").toArrow()
        word = known.column("word").to_numpy().view(U64)
        n = known.column("n").to_numpy()
        self.count = HashIndex(word, n.astype(np.int64))
        by = np.lexsort((word, -n))[: WORDS - 1]
        own, own_n = word[by], n[by]
        if END not in own.tolist():
            own, own_n = np.append(own, U64(END)), np.append(own_n, self.count.find(np.array([END], U64), 0))
        own_types = own[own_n > 0].view(np.int64).tolist()
        rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in own_types], "word long")), "word", "left_anti")
        shared = {r.shared: (r.n, r.types) for r in rest.groupBy("shared").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
        weight = np.zeros(UNITS)
        weight[: len(own)] = own_n + 1
        self.space = np.array([sum(shared.get(k, (0, 0))) + 1 for k in range(SHARED)], np.float64)
        weight[WORDS:] = self.space
        # units by weight, so that a class holds words of like frequency
        rank = np.empty(UNITS, np.int64)
        rank[np.argsort(-weight, kind="stable")] = np.arange(UNITS)
        self.unit = HashIndex(own, rank[: len(own)].astype(np.int64))
        self.shared_unit = rank[WORDS:]
        self.weight = np.empty(UNITS)
        self.weight[rank] = weight + 1e-3
        self.end = int(self.unit.find(np.array([END], U64))[0])

    def units(self, h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each token, and whether it is a shared one."""
        u = self.unit.find(h)
        rare = u < 0
        return np.where(rare, self.shared_unit[shared], u), rare


class Gru:
    """The network: rows of input weights per unit, recurrent weights, and the factored output."""

    NAMES = ("wx", "wh", "wc", "bc", "wo", "bo")

    def __init__(self, p: dict[str, np.ndarray]):
        self.__dict__.update(p)

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 4) -> Gru:
        rng = np.random.default_rng(seed)
        w = vocabulary.weight.reshape(CLASSES, PER_CLASS)
        f = lambda x: np.asarray(x, np.float32)
        return cls({
            "wx": f(rng.normal(0, 0.3, (UNITS, 3 * HIDDEN))), "wh": f(rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))),
            "wc": f(np.zeros((HIDDEN, CLASSES))), "bc": f(np.log(w.sum(1) / w.sum())),
            "wo": f(np.zeros((CLASSES, HIDDEN, PER_CLASS))), "bo": f(np.log(w / w.sum(1, keepdims=True))),
        })

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Gru:
        out, at = {}, 0
        for n in self.NAMES:
            x = getattr(self, n)
            out[n] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return Gru(out)

    def step(self, unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what going back needs."""
        a = self.wx[unit]
        b = h @ self.wh
        zr = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        u = b[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * u)
        return n + z * (h - n), z, r, u, n

    def forward(self, came: np.ndarray, first: np.ndarray, h: np.ndarray, back: bool = True) -> tuple[np.ndarray, ...]:
        """States (steps x HIDDEN x lanes) over a window of units (steps x lanes) from ``h`` (HIDDEN x lanes), and, for ``back``, what going back needs."""
        steps, lanes = came.shape
        gates, kept = 2 * HIDDEN, steps if back else 1
        # a step's values lie unit by unit, lanes side by side
        keep = (~first)[:, None, :].astype(h.dtype)
        # a sigmoid is the tanh of the half, scaled
        half = np.where(np.arange(3 * HIDDEN) < gates, 0.5, 1).astype(h.dtype)
        x, w = self.wx * half, np.ascontiguousarray((self.wh * half).T)
        a, b = np.empty((kept, 3 * HIDDEN, lanes), h.dtype), np.empty((3 * HIDDEN, lanes), h.dtype)
        before, ru = (np.empty((kept, HIDDEN, lanes), h.dtype) for _ in range(2))
        hs = np.empty((steps, HIDDEN, lanes), h.dtype)
        for t in range(steps):
            i = t % kept
            np.copyto(a[i], x.take(came[t], 0).T)
            g, m = a[i, :gates], a[i, gates:]
            was = np.multiply(h, keep[t], out=before[i])
            np.matmul(w, was, out=b)
            g += b[:gates]
            np.tanh(g, g)
            g *= 0.5
            g += 0.5
            m += np.multiply(g[HIDDEN:], b[gates:], out=ru[i])
            np.tanh(m, m)
            h = np.subtract(was, m, out=hs[t])
            h *= g[:HIDDEN]
            h += m
        return hs, before, a[:, :gates], a[:, gates:], ru, keep

    def log_probs(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of units after states (a row each), class by class."""
        by, kind, place, spans = by_class(unit)
        x, at = h[by], np.arange(len(by))
        c = x @ self.wc
        c += self.bc
        o = self.within(x, spans)
        out = np.empty(len(h), h.dtype)
        head, tail = ((picked := y[at, want]) - np.log(np.exp(y, y) @ np.ones(y.shape[1], y.dtype)) for y, want in ((within_limit(c), kind), (o, place)))
        out[by] = head + tail
        return out

    def within(self, x: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits within the class of each row; rows lie class by class."""
        o = np.empty((len(x), PER_CLASS), x.dtype)
        for k, i, j in spans:
            np.matmul(x[i:j], self.wo[k], out=o[i:j])
            o[i:j] += self.bo[k]
        return within_limit(o)


def within_limit(y: np.ndarray) -> np.ndarray:
    """Logits, clipped in place if any is beyond LIMIT: to see that takes less than to clip them all."""
    if y.size and (y.max() > LIMIT or y.min() < -LIMIT):
        np.clip(y, -LIMIT, LIMIT, y)
    return y


def by_class(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order of tokens by class, their classes and places in that order, and where each class stands (class, from, to)."""
    kind = (unit // PER_CLASS).astype(np.uint8)
    by = np.argsort(kind, kind="stable")
    kind = kind[by].astype(np.int64)
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    return by, kind, unit[by] - kind * PER_CLASS, [(k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]


def sums_by_unit(unit: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of n units: the first, second, ... rows of units with few at once, other units one by one."""
    unit = unit.astype(np.uint16)
    by = np.argsort(unit, kind="stable")
    unit = unit[by]
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    size = np.diff(np.append(starts, len(unit)))
    starts = starts[most := np.argsort(-size, kind="stable")]
    size = size[most]
    sums = np.empty((len(starts), rows.shape[1]), rows.dtype)
    many = int(np.searchsorted(-size, -FEW, "left"))  # units with more than FEW
    for k, a, m in zip(range(many), starts.tolist(), size.tolist()):
        np.add.reduce(rows.take(by[a : a + m], 0), 0, out=sums[k])
    rows.take(by[starts[many:]], 0, out=sums[many:], mode="clip")
    for j in range(1, FEW):
        upto = int(np.searchsorted(-size, -j, "left"))  # units with more than j
        if upto <= many:
            break
        sums[many:upto] += rows.take(by[starts[many:upto] + j], 0)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[unit[starts]] = sums
    return out


def deal(lens: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most so many lanes, the longest first, each to the lane that is shortest so far; the longest lane comes first."""
    dealt: list[list[int]] = [[] for _ in range(min(most, len(lens)))]
    load = [(0, k) for k in range(len(dealt))]
    for i in np.argsort(-lens, kind="stable").tolist():
        size, k = load[0]
        dealt[k].append(i)
        heapq.heapreplace(load, (size + int(lens[i]), k))
    return [dealt[k] for _, k in sorted(load, reverse=True)]


def side_by_side(documents: list[np.ndarray], lanes: list[list[int]]) -> tuple[np.ndarray, ...]:
    """The units of all documents lane by lane, whether each begins a document, and where each lane begins and how long it is."""
    order = [i for lane in lanes for i in lane]
    lens = np.array([len(documents[i]) for i in order], np.int64)
    along = np.array([sum(len(documents[i]) for i in lane) for lane in lanes], np.int64)
    units = np.concatenate([documents[i] for i in order]) if order else np.zeros(0, np.uint16)
    first = np.zeros(len(units), bool)
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    return units, first, np.cumsum(along) - along, along


class Trainer:
    """Adam over windows of LANES streams; the state runs on from window to window and starts anew with each document."""

    def __init__(self, net: Gru, rate: float = RATE):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {n: np.zeros_like(getattr(net, n)) for n in Gru.NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in Gru.NAMES}

    def window(self, came: np.ndarray, goes: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """The state (lanes x HIDDEN) after a window (steps x lanes) and the gradients of its mean loss."""
        net, (steps, lanes) = self.net, came.shape
        hs, before, zr, n, ru, keep = net.forward(came, first, h.T)
        count = came.size
        # the class of each token
        c = np.matmul(net.wc.T, hs)
        c += net.bc[:, None]
        within_limit(c)
        np.exp(c, c)
        c *= 1 / (count * c.sum(1, keepdims=True))
        c[np.arange(steps)[:, None], goes // PER_CLASS, np.arange(lanes)] -= 1 / count
        grads = {"wc": np.matmul(hs, c.transpose(0, 2, 1)).sum(0), "bc": c.sum((0, 2)), "wo": np.zeros_like(net.wo), "bo": np.zeros_like(net.bo)}
        # its place there, tokens sorted by class
        by, _, place, spans = by_class(goes.ravel())
        x = hs.transpose(0, 2, 1).reshape(count, HIDDEN)[by]
        o = net.within(x, spans)
        np.exp(o, o)
        o *= (1 / (count * (o @ np.ones(PER_CLASS, o.dtype))))[:, None]
        o[np.arange(count), place] -= 1 / count
        dx, ones = np.empty_like(x), np.ones(count, o.dtype)
        for k, i, j in spans:
            np.matmul(x[i:j].T, o[i:j], out=grads["wo"][k])
            np.matmul(o[i:j], net.wo[k].T, out=dx[i:j])
            np.matmul(ones[: j - i], o[i:j], out=grads["bo"][k])
        dh = np.empty_like(dx)
        dh[by] = dx
        dh = np.ascontiguousarray(dh.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
        dh += np.matmul(net.wc, c)
        # back through the steps: what doesn't depend on the later ones at once
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        free = 1 - z
        to_n, to_z, to_r = free * (1 - n * n), np.subtract(before, n, out=n), 1 - r
        to_z *= z
        to_z *= free
        to_r *= ru
        db, dn, back = np.empty((steps, 3 * HIDDEN, lanes), hs.dtype), np.empty_like(hs), None
        for t in range(steps - 1, -1, -1):
            d = dh[t]
            if back is not None:
                d += back
            m, g = dn[t], db[t]
            np.multiply(d, to_n[t], out=m)
            np.multiply(d, to_z[t], out=g[:HIDDEN])
            np.multiply(m, to_r[t], out=g[HIDDEN : 2 * HIDDEN])
            np.multiply(m, r[t], out=g[2 * HIDDEN :])
            d *= z[t]
            d += net.wh @ g
            d *= keep[t]
            back = d
        grads["wh"] = np.matmul(before, db.transpose(0, 2, 1)).sum(0)
        db[:, 2 * HIDDEN :] = dn
        grads["wx"] = sums_by_unit(came.ravel(), np.ascontiguousarray(db.transpose(0, 2, 1)).reshape(count, 3 * HIDDEN), len(net.wx))
        return hs[-1].T.copy(), grads

    def update(self, g: dict) -> None:
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        self.t += 1
        a = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for n, x in g.items():
            if norm > 1:
                x /= np.float32(norm)
            m, v, w = self.m[n], self.v[n], getattr(self.net, n)
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            x *= x
            x *= np.float32(0.001)
            v *= np.float32(0.999)
            v += x
            np.sqrt(v, x)
            x += np.float32(1e-8)
            np.divide(m, x, x)
            x *= np.float32(a)
            w -= x

    def run(self, documents: Iterator[np.ndarray], end: int) -> int:
        """Train over documents (their units), dealt to lanes of about one length, where they keep their order; gives the number of tokens."""
        documents = [x for x in documents if len(x)]
        lanes = deal(np.array([len(x) for x in documents], np.int64), LANES)
        goes, first, at, along = side_by_side(documents, [sorted(lane) for lane in lanes])
        came = np.where(first, end, np.concatenate((goes[-1:], goes[:-1])))
        h, t = np.zeros((len(lanes), HIDDEN), np.float32), 0
        while live := int(np.searchsorted(-along, -t, "left")):  # lanes longer than t
            steps = min(WINDOW, int(along[live - 1]) - t)
            w = at[:live] + np.arange(t, t + steps)[:, None]
            h, g = self.window(came[w], goes[w], first[w], h[:live])
            self.update(g)
            t += steps
        return len(goes)


def _average(rows: DataFrame) -> tuple[np.ndarray, int] | None:
    """The mean of the weights of ``rows`` (task, weights, n) by their tokens; tasks take means of 32 until few are left, always in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total, count = -1, None, 0

        def mean() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([(total / count).astype(np.float32).tobytes()], pa.binary()), pa.array([count], pa.int64())], ["task", "weights", "n"])

        for batch in batches:
            for t, w, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if t // 32 != task and total is not None:
                    yield mean()
                    total, count = None, 0
                x = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * k
                task, total, count = t // 32, (x if total is None else total + x), count + k
        if total is not None:
            yield mean()

    while (k := rows.count()) > 32:
        dealt = rows.repartition(-(-k // 32), F.expr("task div 32")).sortWithinPartitions("task")
        rows = staged(dealt.mapInArrow(run, "task int, weights binary, n long"), "weights")
    got = sorted(rows.collect(), key=lambda r: r.task)
    if not got:
        return None
    n = sum(r.n for r in got)
    return sum(np.frombuffer(bytes(r.weights), np.float32).astype(np.float64) * (r.n / n) for r in got), n


def train(coded: DataFrame, vocabulary: Vocabulary, units_col: str) -> Gru:
    """Fit the network on all ``coded`` documents (row, turn and their units)."""
    from pyspark import TaskContext

    spark = coded.sparkSession
    sizes = {r.turn: r.size for r in coded.groupBy("turn").agg(F.sum(F.octet_length(units_col)).alias("size")).collect()}
    net, end = Gru.fresh(vocabulary), vocabulary.end
    for turn in sorted(sizes):
        start = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_freed()
            trainer = Trainer(Gru({n: getattr(start.value, n).copy() for n in Gru.NAMES}), RATE / (turn + 1))
            n = trainer.run((np.frombuffer(x.as_buffer(), np.uint16) for b in batches for x in b.column(0)), end)
            if n:
                cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([trainer.net.flat().tobytes()], pa.binary()), pa.array([n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["task", "weights", "n"])

        # a row's task, and its place there, are the same however often it runs
        dealt = coded.where(F.col("turn") == turn).repartition(-(-sizes[turn] // TASK_BYTES), F.xxhash64("row")).sortWithinPartitions("row").select(units_col)
        mean = _average(staged(dealt.mapInArrow(learn, "task int, weights binary, n long"), "weights"))
        if mean is not None:
            net = net.like(mean[0])
    return net


def log_likelihoods(net: Gru, end: int, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document's units, the state carried to its end; lanes of documents run side by side."""
    n, lens = len(starts), ends - starts
    if not n:
        return np.zeros(0)
    dealt = deal(lens, BESIDE)
    goes, first, lane_at, along = side_by_side([units[a:b] for a, b in zip(starts.tolist(), ends.tolist())], dealt)
    order = np.array([i for lane in dealt for i in lane])
    came = np.where(first, end, np.concatenate((goes[-1:], goes[:-1])))
    logs = np.zeros(len(goes), np.float32)
    h = np.zeros((HIDDEN, len(dealt)), net.wx.dtype)
    for t0 in range(0, int(along[0]), WINDOW):
        live = int(np.searchsorted(-along, -t0, "left"))  # lanes longer than t0
        t = t0 + np.arange(min(WINDOW, int(along[0]) - t0))[:, None]
        here = (t < along[:live]).ravel()
        where = np.minimum(lane_at[:live] + t, len(goes) - 1)
        hs = net.forward(came[where], first[where], h[:, :live], back=False)[0]
        h = hs[-1]
        rows, where = hs.transpose(0, 2, 1).reshape(-1, HIDDEN), where.ravel()
        if not here.all():
            rows, where = rows[here], where[here]
        logs[where] = net.log_probs(rows, goes[where])
    return np.bincount(np.repeat(order, lens[order]), logs, n)


_CODED = "row long, id {}, turn int, n_tokens long, n_known long, count_logs double, rare_logs double, units binary, words array<long>, times array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, learns: Column, id_col: str, text_col: str) -> DataFrame:
    """Documents as units, with the round of training of those that the model ``learns`` from, and sums over their words; words without a broadcast count with how often they occur."""
    from pyspark import TaskContext

    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        vocabulary, turn = known.value, TaskContext.get().partitionId()
        space = np.log10(vocabulary.space)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(3))
            learned = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(offsets, 8 << 20):
                n = hi - lo
                h, shared, rows = tokens_in_parts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                units, rare = vocabulary.units(h, shared)
                c = vocabulary.count.find(h)
                found = c >= 0
                logs = np.where(found, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                sizes = np.bincount(rows, minlength=n)
                turns = np.where(learned[lo:hi], (turn + np.cumsum(learned[lo:hi]) - 1) % ROUNDS, -1)
                turn += int(learned[lo:hi].sum())
                ends = np.concatenate(([0], np.cumsum(sizes * 2))).astype(np.int32)  # no more bytes than the text has, and two
                left = np.flatnonzero(~found)
                by = left[np.lexsort((h[left], rows[left]))]
                new = np.ones(len(by), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (rows[by][1:] != rows[by][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(by)))
                off = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows[by[first]], minlength=n)))).astype(np.int32))
                cols = [
                    batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(turns, pa.int32()), pa.array(sizes, pa.int64()),
                    pa.array(np.bincount(rows[found], minlength=n), pa.int64()), pa.array(np.bincount(rows, logs, n).astype(np.float64)),
                    pa.array(np.bincount(rows[rare], (logs - space[shared])[rare], n).astype(np.float64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(units.astype(np.uint16))]),
                    pa.ListArray.from_arrays(off, pa.array(h[by[first]].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "turn", "n_tokens", "n_known", "count_logs", "rare_logs", "units", "words", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), learns.alias("learns"), F.col(text_col).cast("binary").alias("text"))
    return staged(source.mapInArrow(run, _CODED.format(kind)), "units")


def score(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    learns = _labels.remainder(F.col(id_col), modulus) != held
    counts = count_words(docs.where(learns), text_col)
    vocabulary = Vocabulary(counts)
    coded = encode(docs, vocabulary, learns, id_col, text_col)
    net = train(coded.where("turn >= 0").select("row", "turn", "units"), vocabulary, "units")
    context = spark.sparkContext.broadcast((vocabulary.end, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        end, net = context.value
        # batches are pooled: lanes then end together, though some documents are long
        held, size = [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            parts = [text_bytes(b.column(0)) for b in held]
            units = np.concatenate([raw for raw, _ in parts]).view(np.uint16)
            sizes = np.concatenate([np.diff(offsets) for _, offsets in parts]) // 2
            ends = np.cumsum(sizes)
            logs, at = log_likelihoods(net, end, units, ends - sizes, ends) / np.log(10.0), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(logs[at : at + len(b)])], [*b.schema.names[1:], "net_logs"])
                at += len(b)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= POOLED:
                yield from scored()
                held, size = [], 0
        if held:
            yield from scored()
        give_back()

    sums = "row", "id", "n_tokens", "n_known", "count_logs", "rare_logs"
    fields = [coded.schema[name] for name in sums]
    rows = staged(coded.select("units", *sums).mapInArrow(run, StructType([*fields, StructField("net_logs", DoubleType())])), "scored")
    # words below the broadcast bound: their counts come by a join
    asked = coded.where("size(words) > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = counts.where(F.col("n") < vocabulary.least).select("word", "n")
    more = asked.join(tail, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = rows.join(more, "row", "left").na.fill(0, ["more_known"]).na.fill(0.0, ["more_logs"])
    smooth = float(np.log10(vocabulary.tokens + vocabulary.types + 1.0))
    name = id_name(id_col, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return out.select(
        F.col("id").alias(name), (_labels.remainder(F.col("id"), modulus) == held).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("count_logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
        (F.col("net_logs") + F.col("rare_logs") + F.col("more_logs")).alias("score"),
    )
