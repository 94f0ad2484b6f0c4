"""Alignment of two tokenizers' tokens over the bytes that both cut.

For every text two incidence matrices in compressed sparse rows (CSR) tell which bytes
each token covers: A of the byte-level tokenizer and B of the piece model. Row products
A·Bᵀ (Gustavson: a row of the result is the sum of the rows of Bᵀ that the row of A
names) give the overlap links, pairs of tokens that share bytes, with the number of
bytes shared. A token of A whose end is that of its last partner closes a group; the
products of the two token-group incidences give the shared-group links, all pairs of
tokens within a group. Texts of a batch lie end to end as blocks of one matrix, rows are
multiplied a bounded number of entries at a time.

``report`` takes two passes. The first encodes and aligns every text and stages each
document's distinct linked id pairs with how often it links them, packed in bytes. Pairs
are then counted over documents, each task's sums first. The second pass looks counts up:
those of at least ``2**k`` are broadcast, ``k`` being the least for which they are at most
``BROADCAST_PAIRS``; pairs below come by a join, of nobody where ``k`` is 1, as what isn't
in the broadcast then occurs once. The highest count per id of A is broadcast: a number
per id of the vocabulary.

Defined results: null and empty texts, texts whose tokens don't spell a space and the
text (such as ones with the piece model's own space mark) and bytes that aren't UTF-8
have no tokens: zeros and an empty groups string. Strings of special tokens are plain
text. Repeated rows, null and repeated ids give a row each and count each as a document;
an empty table gives an empty table; an id column called like a column of the result gets
an underscore behind its name; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import id_name, small_batches, staged
from ._vector import HashIndex, U64, chunks, lists_of, remember, text_bytes
from .sentencepiece_codec import MARK, agenda
from .token_file import _spread, encoder

#: Pairs whose counts are broadcast at most: 16 MiB of keys and counts.
BROADCAST_PAIRS = 1 << 20
#: Bytes of text that are aligned at once (a longer text stands alone), entries of a product, and pairs that a task sums up before it sends them.
TEXT_BYTES, ENTRIES, SUMMED = 1 << 20, 1 << 21, 1 << 21


class Csr(NamedTuple):
    """A sparse matrix of counts: row i has ``data`` at the columns ``indices[indptr[i] : indptr[i + 1]]``, in ascending order."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def ones(cls, sizes: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
        return cls(np.concatenate(([0], np.cumsum(sizes))), indices, np.ones(len(indices), np.int64), columns)

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.columns)))), rows[order], self.data[order], len(self.indptr) - 1)

    def blocks(self, other: Csr, entries: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product with ``other`` as (row, column, value), rows ascending: so many rows at once as have ``entries`` products, one row at least."""
        size = np.diff(other.indptr)[self.indices]
        work = np.concatenate(([0], np.cumsum(size)))[self.indptr]  # products before each row
        n, lo = len(self.indptr) - 1, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + entries, "right")) - 1)
            a, b = self.indptr[lo], self.indptr[hi]
            take = _spread(other.indptr[self.indices[a:b]], size[a:b])
            row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(self.indptr[lo : hi + 1])), size[a:b])
            key = row * other.columns + other.indices[take]
            value = other.data[take] * np.repeat(self.data[a:b], size[a:b])
            if (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if len(first):
                yield key[first] // other.columns, key[first] % other.columns, np.add.reduceat(value, first)
            lo = hi

    def __matmul__(self, other: Csr) -> Csr:
        parts = list(self.blocks(other))
        row, column, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        sizes = np.bincount(row, minlength=len(self.indptr) - 1)
        return Csr(np.concatenate(([0], np.cumsum(sizes))), column, value, other.columns)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, others in turn from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelling:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.len = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.len) - self.len
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_spread(self.start[ids], self.len[ids])]


class Aligned(NamedTuple):
    """The tokens of a batch's aligned texts, end to end: ids, which text each is of, the group each is in, and the overlap links."""

    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    overlaps: Csr


def _overlaps(end_a: np.ndarray, end_b: np.ndarray, entries: int = ENTRIES) -> Csr:
    """A·Bᵀ of the incidences of tokens that end at these bytes: for so many rows at once as cover ``entries`` bytes, one at least."""
    parts, lo, start = [], 0, 0
    while lo < len(end_a):
        hi = max(lo + 1, int(np.searchsorted(end_a, start + entries, "right")))
        stop = int(end_a[hi - 1])
        j, k = int(np.searchsorted(end_b, start, "right")), int(np.searchsorted(end_b, stop, "left")) + 1
        covered = np.diff(np.minimum(end_b[j:k], stop), prepend=start)
        a = Csr.ones(np.diff(end_a[lo:hi], prepend=start), np.arange(stop - start), stop - start)
        b = Csr.ones(np.ones(stop - start, np.int64), np.repeat(np.arange(k - j), covered), k - j)  # transposed: each byte has one token
        c = a @ b
        parts.append((np.diff(c.indptr), c.indices + j, c.data))
        lo, start = hi, stop
    sizes, indices, data = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    return Csr(np.concatenate(([0], np.cumsum(sizes))), indices, data, len(end_b))


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.coder, self.pieces = encoder(byte_path, plain=True), agenda(piece_path)
        vocab, byte = self.coder.lib.get_vocab(with_added_tokens=True), _byte_of()
        added = self.coder.lib.get_added_tokens_decoder()
        self.n_a, self.n_b = max(vocab.values()) + 1, self.pieces.lib.get_piece_size()
        spelled = [b""] * self.n_a
        for token, i in vocab.items():
            spelled[i] = token.encode() if i in added else bytes(map(byte.__getitem__, token))
        self.spell_a = Spelling(spelled)
        names = map(self.pieces.lib.id_to_piece, range(self.n_b))
        self.spell_b = Spelling([bytes([int(p[3:5], 16)]) if self.pieces.lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)])
        self.digits = Spelling([str(i).encode() + b"," for i in range(max(self.n_a, self.n_b))])

    def align(self, raw: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Tokens of all texts that both tokenizers spell alike; ``text_a`` and ``text_b`` number the rows."""
        n, lens = len(offsets) - 1, np.diff(offsets)
        some = lens > 0
        # a space before each text that isn't empty
        spaced = np.full(len(raw) + int(some.sum()), 32, np.uint8)
        spaced[_spread(offsets[:-1] + np.cumsum(some), lens)] = raw
        lens = lens + some
        ends = np.cumsum(lens)
        a, size_a = self.coder.encode(spaced, np.concatenate(([0], ends)), 0)
        a = np.delete(a, np.cumsum(size_a) - 1).astype(np.int64)  # without the ids that end texts
        size_a = size_a - 1
        texts = [raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        lists = [np.array(x, np.int64) for x in self.pieces.encode(texts)]
        b, size_b = np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([len(x) for x in lists], np.int64)
        text_a, text_b = np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)
        good = some & self._spells(self.spell_a, a, text_a, spaced, ends, lens) & self._spells(self.spell_b, b, text_b, spaced, ends, lens)
        keep_a, keep_b = good[text_a], good[text_b]
        return self._grouped(a[keep_a], b[keep_b], text_a[keep_a], text_b[keep_b])

    @staticmethod
    def _spells(spelling: Spelling, ids: np.ndarray, text: np.ndarray, raw: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Of which texts the ids' bytes are all bytes."""
        same = np.bincount(text, spelling.len[ids], len(lens)).astype(np.int64) == lens
        ids = ids[same[text]]
        want = raw[_spread((ends - lens)[same], lens[same])]
        off = np.flatnonzero(spelling.of(ids) != want)
        if len(off):
            rows = np.flatnonzero(same)
            same[rows[np.searchsorted(np.cumsum(lens[same]), off, "right")]] = False
        return same

    def _grouped(self, a: np.ndarray, b: np.ndarray, text_a: np.ndarray, text_b: np.ndarray) -> Aligned:
        end_a, end_b = np.cumsum(self.spell_a.len[a]), np.cumsum(self.spell_b.len[b])
        overlaps = _overlaps(end_a, end_b)
        last = overlaps.indices[overlaps.indptr[1:] - 1]
        closes = end_a == end_b[last]
        group_a = np.cumsum(closes) - closes
        group_b = np.zeros(len(b), np.int64)
        group_b[overlaps.indices] = np.repeat(group_a, np.diff(overlaps.indptr))
        return Aligned(a, b, text_a, text_b, group_a, group_b, overlaps)

    def linked_pairs(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how often each text links each pair of ids, ordered; a pair is id of A x vocabulary of B + id of B."""
        n_groups = int(x.group_a[-1]) + 1 if len(x.a) else 0
        in_a, in_b = Csr.ones(np.ones(len(x.a), np.int64), x.group_a, n_groups), Csr.ones(np.ones(len(x.b), np.int64), x.group_b, n_groups)
        space, keys, times = self.n_a * self.n_b, [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for i, j, _ in in_a.blocks(in_b.transposed()):
            k, n = np.unique(x.text_a[i].astype(U64) * U64(space) + (x.a[i] * self.n_b + x.b[j]).astype(U64), return_counts=True)
            keys.append(k), times.append(n)
        if len(keys) > 2:  # a text's pairs from several blocks
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(where, np.concatenate(times)).astype(np.int64)
        else:
            k, n = keys[-1], times[-1]
        return (k // U64(space)).astype(np.int64), k % U64(space), n

    def groups_text(self, x: Aligned, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts' ``a1,a2|b1;a3|b2,b3`` and where each ends; one byte, a separator, follows each that isn't empty."""
        group = np.concatenate((x.group_a, x.group_b))
        order = np.argsort(group, kind="stable")  # of a group the tokens of A come first
        ids, lens = np.concatenate((x.a, x.b))[order], self.digits.len
        out = self.digits.of(ids)
        ends = np.cumsum(lens[ids])
        is_a, group = order < len(x.a), group[order]
        out[ends[np.flatnonzero(is_a[:-1] & ~is_a[1:])] - 1] = ord("|")
        out[ends[np.flatnonzero(group[:-1] != group[1:])] - 1] = ord(";")
        text = np.concatenate((x.text_a, x.text_b))[order]
        return out, np.cumsum(np.bincount(text, lens[ids], n_texts)).astype(np.int64)


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """A worker's own, which remembers words from task to task."""
    remember("aligner", _aligner.cache_clear)
    return _aligner(byte_path, piece_path)


def _text_chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(column))
        for lo, hi in chunks(offsets, TEXT_BYTES):
            yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


_LINKS = "id {}, a array<int>, b array<int>, group_a array<int>, group_b array<int>, over_a array<int>, over_b array<int>, n_shared array<int>"


def links(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, its ids a and b, the number of the group of each token, and the overlap links as token numbers over_a, over_b with the bytes n_shared."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(byte_path, piece_path)
        for part, raw, offsets in _text_chunks(batches, 1):
            x, n = coder.align(raw, offsets), len(offsets) - 1
            size_a, size_b = np.bincount(x.text_a, minlength=n), np.bincount(x.text_b, minlength=n)
            before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            row = np.repeat(np.arange(len(x.a)), np.diff(x.overlaps.indptr))
            text = x.text_a[row]
            first = x.group_a[np.minimum(before_a, max(0, len(x.a) - 1))] if len(x.a) else np.zeros(n, np.int64)
            n_over, kind = np.bincount(text, minlength=n), pa.int32()
            cols = [
                part.column(0), lists_of(x.a, size_a, kind), lists_of(x.b, size_b, kind), lists_of(x.group_a - first[x.text_a], size_a, kind), lists_of(x.group_b - first[x.text_b], size_b, kind),
                lists_of(row - before_a[text], n_over, kind), lists_of(x.overlaps.indices - before_b[text], n_over, kind), lists_of(x.overlaps.data, n_over, kind),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "a", "b", "group_a", "group_b", "over_a", "over_b", "n_shared"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, _LINKS.format(kind)).withColumnRenamed("id", id_name(id_col, [x.split()[0] for x in _LINKS.split(", ")[1:]]))


_PAIRED = "row long, id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _paired(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """Per row its counts, the digest of its groups, and its linked pairs of ids (64-bit numbers) with their times (32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(byte_path, piece_path)
        for part, raw, offsets in _text_chunks(batches, 2):
            x, n = coder.align(raw, offsets), len(offsets) - 1
            text, pair, times = coder.linked_pairs(x)
            spelled, ends = coder.groups_text(x, n)
            starts = np.concatenate(([0], ends[:-1]))
            digest = ["" if i == j else hashlib.sha256(spelled[i : j - 1]).hexdigest() for i, j in zip(starts.tolist(), ends.tolist())]
            group = np.flatnonzero(np.diff(x.group_a, prepend=-1))
            count = lambda of, weights=None: pa.array(np.bincount(of, weights, n).astype(np.int64))
            cut = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).tolist()
            pair, small = pair.astype("<u8"), times.astype("<u4")
            cols = [
                part.column(0), part.column(1), count(x.text_a), count(x.text_b), count(x.text_a[group]), count(text, times), pa.array(digest, pa.string()),
                pa.array([pair[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([small[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return staged(source.mapInArrow(run, _PAIRED.format(kind)), "paired")


def pair_counts(paired: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each linked pair. Tasks send sums, of at most ``SUMMED`` pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, U64), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(sums)], ["pair", "n"])

        for batch in batches:
            keys, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), U64), return_counts=True)
            held, where = np.unique(np.concatenate((held, keys)), return_inverse=True)
            sums = np.bincount(where, np.concatenate((sums, n)), len(held)).astype(np.int64)
            if len(held) >= SUMMED:
                yield flush()
                held, sums = np.zeros(0, U64), np.zeros(0, np.int64)
        if len(held):
            yield flush()

    return staged(paired.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def report(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    paired = _paired(docs, byte_path, piece_path, id_col, text_col)
    counts = pair_counts(paired)
    n_b = aligner(byte_path, piece_path).n_b
    by_size = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least = 1
    while sum(n for k, n in by_size.items() if k >= least) > most:
        least += 1
    told = counts.where(F.col("n") >= 1 << least).toArrow()
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("best"))  # a row per id of the vocabulary
    highest = best.toArrow()
    facts = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for t, names in ((told, ("pair", "n")), (highest, ("a", "best"))) for c in names))
    joined = least > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, a, top = facts.value
        known, high = HashIndex(pairs.view(U64), n), np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64)
        high[a] = top
        for batch in batches:
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(7)], np.int64)
            pair, times = np.frombuffer(b"".join(batch.column(7).to_pylist()), U64), np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            count = known.find(pair, 0 if joined else 1)
            left = np.flatnonzero(count == 0)
            is_best = count == high[(pair // U64(n_b)).astype(np.int64)] if len(pair) else np.zeros(0, bool)
            sums = [pa.array(_sum(row, v, batch.num_rows)) for v in (times * is_best, times * count)]
            off = np.bincount(row[left], minlength=batch.num_rows)
            cols = [*batch.columns[:7], *sums, lists_of(pair[left].view(np.int64), off, pa.int64()), lists_of(times[left], off, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:7], "n_best", "count_sum", "rare", "rare_times"])

    schema = _PAIRED.format(docs.schema[id_col].dataType.simpleString()).replace("pairs binary, times binary", "n_best long, count_sum long, rare array<long>, rare_times array<long>")
    out = paired.mapInArrow(run, schema)
    if joined:
        out = staged(out, "scored")
        rare = out.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
        low = counts.where(F.col("n") < 1 << least).withColumn("a", F.expr(f"pair div {n_b}")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
        more = rare.join(low, "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").na.fill(0, ["more_best", "more_sum"]).withColumns({"n_best": F.expr("n_best + more_best"), "count_sum": F.expr("count_sum + more_sum")})
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(F.col("id").alias(id_name(id_col, results)), *results)


def _sum(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by row, rows ascending."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(np.bincount(row, minlength=n))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))] if n else np.zeros(0, np.int64)
