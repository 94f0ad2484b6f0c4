"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Every word of every document belongs to a bucket of its hash; so does its shape
(letters, capitals, digits as classes, runs of a class as one). A bucket has a sparse
random index vector, and its word vector is the sum of the index vectors of what stands
up to two places away, over all documents. Tasks sum in arrays of fixed size; these are
summed by a shuffle of bounded numbers per task and give a table of
BUCKETS x DIM numbers, which is broadcast. A document is pooled to the weighted mean and
spread of its words' and its shapes' vectors, with its length and how often words come again, in one pass; these rows are written, so that texts
are read twice in all. The network (one hidden layer) is fitted in numpy on at most
``MAX_LABELLED`` labelled rows; a fifth of them is kept apart to fit the temperature
that its scores are divided by.

Defined results: null text counts as empty, empty texts are scored like any other; without
labelled rows every score is 0.5; an id's several labels count as their majority; repeated
rows get equal scores; null ids are scored; other columns are not read by ``score``, and
``keep`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _labels
from ._store import staged
from ._vector import U64, chunks, forget_others, mix, text_bytes, word_hashes, word_spans

BUCKETS = 8192
DIM = 32
#: Non-zero entries of an index vector.
SPARSE = 4
REACH = 2
#: Words as frequent as this weigh half.
HALF = 1e-3
FEATURES = 4 * DIM + 4
#: The bound of the sample that the network is fitted on.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
HIDDEN = 32
#: Bytes of text whose words are counted at once; each takes some thirty bytes of arrays.
PART = 1 << 20
#: Bytes of text that are pooled at once; each takes some hundred bytes of arrays.
POOLED = 1 << 18

#: Shapes: a byte's class; marks stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = 0x80


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its non-zero entries and their signs."""
    h = mix(np.arange(BUCKETS * SPARSE, dtype=U64) + U64(1)).reshape(BUCKETS, SPARSE)
    return (h % U64(DIM)).astype(np.int64), np.where(h >> U64(63), 1.0, -1.0)


def buckets_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape bucket of each word, and its row."""
    starts, ends, rows = word_spans(raw, offsets)
    words = (word_hashes(raw, starts, ends) % U64(BUCKETS)).astype(np.int64)
    kind = _SHAPE[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    at = np.concatenate(([0], np.cumsum(new)))
    shapes = word_hashes(kind[new], at[starts], at[ends], lower=False) + U64(77)
    return words, (mix(shapes) % U64(BUCKETS)).astype(np.int64), rows


def _context(ids: np.ndarray, rows: np.ndarray, total: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``total`` (BUCKETS x (DIM + 1), the last column counts) what stands around each word."""
    total[:, DIM] += np.bincount(ids, minlength=BUCKETS)
    for gap in range(1, REACH + 1):
        same = rows[gap:] == rows[:-gap]
        left, right = ids[:-gap][same], ids[gap:][same]
        for a, b in ((left, right), (right, left)):
            for s in range(SPARSE):
                flat = np.bincount(a * DIM + places[b, s], weights=signs[b, s], minlength=BUCKETS * DIM)
                total[:, :DIM] += flat.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x (DIM + 1): unit vectors over all documents, and each bucket's weight."""
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        total = np.zeros((BUCKETS, DIM + 1))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for lo, hi in chunks(offsets, PART):
                words, shapes, rows = buckets_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for ids in (words, shapes):
                    _context(ids, rows, total, places, signs)
        flat = total.astype(np.int64).ravel()
        used = np.flatnonzero(flat)
        for k in range(0, len(used), 65536):
            part = used[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(flat[part])], ["cell", "value"])

    cells = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "cell int, value long")
    table = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(BUCKETS * (DIM + 1))
    total[table.column("cell").to_numpy()] = table.column("value").to_numpy()
    total = total.reshape(BUCKETS, DIM + 1)
    counts = total[:, DIM].copy()
    total[:, :DIM] /= np.maximum(np.linalg.norm(total[:, :DIM], axis=1, keepdims=True), 1e-9)
    total[:, DIM] = HALF / (HALF + counts / max(1.0, counts.sum()))
    return total.astype(np.float32)


def _pool(ids: np.ndarray, starts: np.ndarray, rows: np.ndarray, n_rows: int, vectors: np.ndarray) -> np.ndarray:
    """Weighted mean and spread of each row's vectors; zeros for rows without words."""
    out = np.zeros((n_rows, 2 * DIM), np.float32)
    if len(ids):
        w = vectors[ids, DIM : DIM + 1]
        v = vectors[ids, :DIM]
        has = np.unique(rows)
        at = starts[has]
        weight = np.add.reduceat(w, at, dtype=np.float64)
        mean = np.add.reduceat(v * w, at, dtype=np.float64) / weight
        square = np.add.reduceat(v * v * w, at, dtype=np.float64) / weight
        out[has] = np.hstack((mean, np.sqrt(np.maximum(square - mean**2, 0))))
    return out


def features(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    n = len(offsets) - 1
    words, shapes, rows = buckets_of(raw, offsets)
    counts = np.bincount(rows, minlength=n)
    starts = np.cumsum(counts) - counts
    out = np.zeros((n, FEATURES), np.float32)
    out[:, : 2 * DIM] = _pool(words, starts, rows, n, vectors)
    out[:, 2 * DIM : 4 * DIM] = _pool(shapes, starts, rows, n, vectors)
    out[:, 4 * DIM] = np.log1p(counts)
    out[:, 4 * DIM + 1] = np.log1p(np.diff(offsets))
    pairs = np.unique(rows * BUCKETS + words) // BUCKETS
    out[:, 4 * DIM + 2] = np.bincount(pairs, minlength=n) / np.maximum(counts, 1)
    again = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out[:, 4 * DIM + 3] = np.bincount(rows[1:][again], minlength=n) / np.maximum(counts, 1)
    return out


def features_by_part(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of texts of at most ``POOLED`` bytes, or one text, and their features."""
    for lo, hi in chunks(offsets, POOLED):
        yield lo, hi, features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], vectors)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every document, as bytes of 32-bit floats."""
    context = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi, x in features_by_part(raw, offsets, context.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, x binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradients(p: list[np.ndarray], z: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean logistic loss of a network's parameters, with half of ``decay`` times the squares of its weights."""
    h = np.maximum(z @ p[0] + p[1], 0)
    g = (_sigmoid(h @ p[2] + p[3]) - y) / len(y)
    back = np.outer(g, p[2]) * (h > 0)
    return [z.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]


class Network:
    """Features, standardised, through a hidden layer to a logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 40, rate: float = 3e-3, decay: float = 3e-3):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        apart, fit = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        d = x.shape[1]
        p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3))])]
        m, v, t = [0 * q for q in p], [0 * q for q in p], 0
        z = self._scaled(x)
        for _ in range(epochs):
            for k in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                grads = gradients(p, z[k], y[k], decay)
                t += 1
                for i, q in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * q
                    v[i] = 0.999 * v[i] + 0.001 * q * q
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(apart) and 0 < y[apart].mean() < 1:
            logit = self._logit(x[apart])
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
            # a few rows that are all right would make any score certain: targets are drawn in as by one wrong row in each class
            good, bad = y[apart].sum(), len(apart) - y[apart].sum()
            aim = np.where(y[apart] > 0, (good + 1) / (good + 2), 1 / (bad + 2))
            loss = [-np.mean(aim * np.log(_sigmoid(logit / t) + 1e-12) + (1 - aim) * np.log(_sigmoid(-logit / t) + 1e-12)) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._scaled(x) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(x) / self.temperature)


def fit(rows: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, limit: int = MAX_LABELLED) -> Network | None:
    """Learn from the pooled rows of labelled ids outside the held-out fold."""
    chosen = F.broadcast(_labels.sample(_labels.usable(labels, column, modulus, held), limit, 3))  # at most ``limit`` rows
    got = rows.join(chosen, "id").orderBy(F.xxhash64("id", F.lit(3)), "id", "x").limit(2 * limit).collect()
    if not got:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), -1).astype(np.float64)
    return Network(x, np.array([r.label for r in got], np.float64))


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    rows = staged(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "pooled")
    context = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, column, modulus, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        net = context.value
        for batch in batches:
            n = batch.num_rows
            if net is None or not n:
                s = np.full(n, 0.5)
            else:
                s = net.score(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(n, -1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (_labels.remainder(F.col("id"), modulus) == held).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, held: int = 0, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, whose score reaches the threshold; each row is scored where it stands."""
    vectors = word_vectors(docs, text_col)
    chosen = _labels.sample(_labels.usable(labels, column, modulus, held), MAX_LABELLED, 3)
    known = docs.select(id_col, text_col).join(F.broadcast(chosen.select(F.col("id").alias(id_col))), id_col, "left_semi")
    net = fit(staged(pooled(known, vectors, id_col, text_col), "pooled"), labels, column, modulus, held)
    context = docs.sparkSession.sparkContext.broadcast((vectors, net))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        vectors, net = context.value
        for batch in batches:
            if net is None:
                yield pa.RecordBatch.from_arrays(batch.columns, columns)
                continue
            raw, offsets = text_bytes(batch.column(columns.index(text_col)))
            for lo, hi, x in features_by_part(raw, offsets, vectors):
                part = batch.slice(lo, hi - lo).filter(pa.array(net.score(x.astype(np.float64)) >= threshold))
                yield pa.RecordBatch.from_arrays(part.columns, columns)

    return docs.mapInArrow(run, docs.schema)
