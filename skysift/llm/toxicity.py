"""Toxicity classifier with a counterfactual penalty.

A document's features are the words and word beginnings that occur in it, out of a
list that the labelled rows choose: tasks count in how many labelled documents of each
class a feature occurs, the counts are summed by a shuffle, and those are kept whose
frequencies differ most surely. A linear model over them is fitted with a second loss: in a
sentence of each labelled document an identity term is swapped for another of its kind
(a sentence without one is given one), and the squared change of the score is penalised.
So naming a group, by itself, moves no score.

The model is fitted on at most ``MAX_PER_CLASS`` labelled ids of either class, one row of
each (that with the smallest hash of its text), weighted to the classes' true shares. Counting, fitting and scoring read whole texts; scoring is
one narrow pass.

Defined results: null text counts as empty, empty texts get the intercept's score; without
labelled rows of both classes every score is 0; an id's several labels count as their
majority; repeated rows get equal scores; null ids are scored; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _labels
from ._store import staged
from ._vector import U64, HashIndex, chunks, mix, text_bytes, word_hashes, word_spans

#: The bound of the sample that the model is fitted on.
MAX_PER_CLASS = 8000
#: The list's length at most, and in how many sampled documents of a class a feature must occur.
MAX_FEATURES = 4096
LEAST_DOCUMENTS = 4
#: How far a feature's log frequencies in the two classes must differ, and in standard errors.
LEAST_ODDS = 1.5
LEAST_SURE = 2.5
#: Lengths of word beginnings, in bytes.
BEGINNINGS = (3, 4, 5, 6)
PENALTY = 2.0
THRESHOLD = 0.3

#: Terms that name groups, by kind: within a kind they are swapped for each other.
IDENTITY_TERMS = {
    "religion": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists sikh sikhs atheist atheists catholic catholics protestant protestants".split(),
    "origin": "african africans american americans arab arabs asian asians british chinese european europeans french german germans indian indians irish italian italians japanese mexican mexicans polish russian russians spanish turkish immigrant immigrants refugee refugees foreigner foreigners".split(),
    "colour": "black white brown".split(),
    "gender": "woman women man men girl girls boy boys female male transgender".split(),
    "orientation": "gay lesbian bisexual straight queer homosexual heterosexual".split(),
    "age": "old young elderly teenager teenagers".split(),
    "ability": "disabled deaf blind autistic".split(),
    "de": "christen muslime juden frauen männer ausländer flüchtlinge schwule lesben behinderte".split(),
    "fr": "chrétiens musulmans juifs femmes hommes étrangers réfugiés homosexuels lesbiennes handicapés".split(),
    "es": "cristianos musulmanes judíos mujeres hombres extranjeros refugiados homosexuales lesbianas discapacitados".split(),
}

#: What stands between words: all ASCII but letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x41:0x5B] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False
_KIND = {t: k for k, ts in IDENTITY_TERMS.items() for t in ts}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, _KIND), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def feature_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and their rows."""
    starts, ends, rows = word_spans(raw, offsets, _BETWEEN)
    out, owner = [word_hashes(raw, starts, ends)], [rows]
    for k in BEGINNINGS:
        long = ends - starts > k
        out.append(mix(word_hashes(raw, starts[long], starts[long] + k) + U64(k)))
        owner.append(rows[long])
    return np.concatenate(out), np.concatenate(owner)


def counterfactual(text: str, turn: int) -> tuple[str, str]:
    """A sentence of the text that names a group, and the same with another group of its kind."""
    found = [m[0] for m in _SENTENCE.finditer(text)] or [""]
    named = [s for s in found if _TERM.search(s)]
    if named:
        one = named[turn % len(named)]
        swap = lambda m: (ts := IDENTITY_TERMS[_KIND[m[0].lower()]])[(ts.index(m[0].lower()) + 1 + turn % (len(ts) - 1)) % len(ts)]
        return one, _TERM.sub(swap, one)
    one, kinds = found[turn % len(found)].split(" "), list(IDENTITY_TERMS.values())
    terms, at = kinds[turn % len(kinds)], turn % (len(one) + 1)
    place = lambda t: " ".join(one[:at] + [t] + one[at:])
    return place(terms[turn // 7 % len(terms)]), place(terms[(turn // 7 + 1 + turn % (len(terms) - 1)) % len(terms)])


def _counts(known: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many of the rows (label, text) of each class a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                h, rows = feature_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                by = np.lexsort((rows, h))
                h, rows = h[by], rows[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                h, toxic = h[new], label[lo:hi][rows[new]]
                h, first = np.unique(h, return_index=True)
                both = np.add.reduceat(np.stack((toxic, 1 - toxic), 1).astype(np.int64), first) if len(first) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["feature", "toxic", "clean"])

    part = known.select("label", "text").mapInArrow(run, "feature long, toxic long, clean long")
    return part.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def identity_features() -> np.ndarray:
    terms = sorted(_KIND)
    data = " ".join(terms).encode()
    return np.unique(feature_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])


def _occurring(index: HashIndex, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Listed features of each text, once each, and their rows."""
    h, rows = feature_hashes(raw, offsets)
    got = index.find(h)
    hit = got >= 0
    size = len(index.value) + 1
    pairs = np.unique(rows[hit] * size + got[hit])
    return pairs % size, pairs // size


def _examples(known: DataFrame, index: HashIndex) -> DataFrame:
    """(id, label, x, a, b): listed features of each sampled text, and of its two counterfactual sentences."""
    context = known.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(texts: list[bytes]) -> pa.Array:
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            got, rows = _occurring(context.value, np.frombuffer(b"".join(texts), np.uint8), off)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(texts))))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(got.astype(np.int32)))

        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for lo, hi in chunks(offsets):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(2).to_pylist()]
                pairs = [counterfactual(t.decode("utf-8", "replace"), zlib.crc32(f"{i}|11".encode()) & 0xFFFF) for i, t in zip(part.column(0).to_pylist(), texts)]
                cols = [part.column(0), part.column(1), lists(texts), *(lists([p[k].encode() for p in pairs]) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "label", "x", "a", "b"])

    kind = known.schema["id"].dataType.simpleString()
    return known.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, x array<int>, a array<int>, b array<int>")


def gradients(w: np.ndarray, bias: float, x: tuple, a: tuple, b: tuple, y: np.ndarray, weight: np.ndarray, decay: float, penalty: float) -> tuple[np.ndarray, float]:
    """Of the weighted mean logistic loss, half of ``decay`` times the squares of the weights, and half of ``penalty`` times
    the mean square of what a swap changes; ``x``, ``a`` and ``b`` are features and rows of the texts and of both sentences."""
    n, size = len(y), len(w)
    z = np.bincount(x[1], w[x[0]], n) + bias
    e = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
    d = penalty * (np.bincount(a[1], w[a[0]], n) - np.bincount(b[1], w[b[0]], n)) / n
    return decay * w + np.bincount(x[0], e[x[1]], size) + np.bincount(a[0], d[a[1]], size) - np.bincount(b[0], d[b[1]], size), float(e.sum())


class Model:
    """Weights of listed features and an intercept."""

    def __init__(self, x: list, a: list, b: list, y: np.ndarray, weight: np.ndarray, size: int, seed: int = 9, epochs: int = 60, rate: float = 0.05, decay: float = 2e-5, penalty: float = PENALTY):
        rng = np.random.default_rng(seed)
        weight = weight / weight.mean()
        share = float((weight * y).sum() / weight.sum())
        w, bias = np.zeros(size), np.log((share + 1e-4) / (1 - share + 1e-4))
        m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
        for _ in range(epochs):
            for k in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
                g, gb = gradients(w, bias, _flat(x, k), _flat(a, k), _flat(b, k), y[k], weight[k], decay, penalty)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                c, s = 1 - 0.9**t, 1 - 0.999**t
                w = w - rate * (m / c) / (np.sqrt(v / s) + 1e-8)
                bias -= rate * (mb / c) / (np.sqrt(vb / s) + 1e-8)
        self.w, self.bias = w, bias

    def score(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(rows, self.w[features], n) + self.bias, -60, 60)))


def _flat(lists: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = [lists[i] for i in rows]
    return np.concatenate(some).astype(np.int64), np.repeat(np.arange(len(rows)), [len(s) for s in some])


def fit(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> tuple[HashIndex, Model] | None:
    """The list of features and the model, learned from labelled rows outside the held-out fold."""
    rows = _labels.usable(labels, column, modulus, held)
    share = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return None
    chosen = F.broadcast(_labels.sample(rows.where("label = 1"), MAX_PER_CLASS, 8).union(_labels.sample(rows.where("label = 0"), MAX_PER_CLASS, 8)))
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(chosen, "id")
    known = staged(known.select("id", "label", "text", F.monotonically_increasing_id().alias("row")), "labelled")
    # however many rows an id has, one teaches: at most as many rows as ids
    one = known.groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("text"), "row")).alias("row")).select("row")
    known = known.join(F.broadcast(one), "row", "left_semi")
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    odds = F.abs(F.log((F.col("toxic") + 0.5) / n[1]) - F.log((F.col("clean") + 0.5) / n[0]))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    often = _counts(known).where(f"toxic >= {LEAST_DOCUMENTS} or clean >= {LEAST_DOCUMENTS}").select("feature", odds.alias("odds"), sure.alias("sure"))
    listed = often.where(f"odds >= {LEAST_ODDS} and sure >= {LEAST_SURE}").orderBy(F.desc("sure"), "feature").limit(MAX_FEATURES).select("feature").collect()
    keys = np.union1d(np.array([r.feature for r in listed], np.int64).view(U64), identity_features())
    index = HashIndex(keys, np.arange(len(keys)))
    data = sorted(_examples(known, index).collect(), key=lambda r: r.id)  # at most MAX_PER_CLASS rows of each class
    y = np.array([r.label for r in data], np.float64)
    weight = np.where(y > 0, share[1] / n[1], share[0] / n[0])
    model = Model([r.x for r in data], [r.a for r in data], [r.b for r in data], y, weight, len(keys), penalty=penalty)
    return index, model


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, penalty: float = PENALTY) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    context = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column, modulus, held, id_col, text_col, penalty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                s = np.zeros(hi - lo)
                if context.value is not None:
                    index, model = context.value
                    got, rows = _occurring(index, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    s = model.score(got, rows, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (_labels.remainder(F.col("id"), modulus) == held).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
