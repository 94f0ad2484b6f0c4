"""Benchmark decontamination by windows of normalised words.

Tasks make the benchmark's windows: hashes, and where each stands in its item's normalised
words. They are broadcast as sorted arrays over one buffer of words; tasks hash every window of
every training text, look it up, and compare the words themselves where a hash is found. What
one broadcast holds is at most about ``SLICE_BYTES``, windows included. Equal windows are one
entry with a list of items, and a row takes each such list once, however often its windows
occur. A larger benchmark takes several passes, each with its own broadcast, over the training
texts, which are numbered and written once before; passes keep rows with hits only, whose
spans meet by row. With one pass nothing shuffles.

Defined results: null texts and items have no words; an item with fewer words than a
window is one window; repeated items and rows count each; null item ids are named
``null``; an empty benchmark contaminates nothing; other columns pass through, whatever their
names, but ``scan`` replaces those that are called as the columns that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import staged
from ._vector import _LOWER, BASE, U64, UPPER_TO_LOWER, chunks, forget_others, mix, powers, text_bytes, word_hashes, word_spans

#: What one pass broadcasts: words, and WINDOW_BYTES per window.
SLICE_BYTES = 64 << 20
WINDOW_BYTES = 28
#: Windows in a row of the benchmark's table; longer items have several.
ROW_WINDOWS = 1 << 14
WINDOW = 10
#: What stands between words; A-Z count as a-z.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x41:0x5B] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j, p in enumerate(powers(BASE, size).tolist()):
        out += words[j : j + n] * U64(p)
    return mix(out + U64(size))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Rows (name, n, text, hashes, starts, stops) of ``items`` (name, text): windows of n words, and their bytes in the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part, names = raw[offsets[lo] : offsets[hi]], batch.column(0).slice(lo, hi - lo).to_pylist()
                a, b, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo], _BETWEEN)
                h, low = word_hashes(part, a, b), _LOWER[part]
                ends = np.cumsum(np.bincount(rows, minlength=hi - lo))
                out = []
                for name, i, j in zip(names, [0, *ends[:-1].tolist()], ends.tolist()):
                    n = min(size, j - i)
                    for k in range(i, j - n + 1 if n else i, ROW_WINDOWS):
                        to = min(j, k + ROW_WINDOWS + n - 1)
                        text = b" ".join(low[x:y].tobytes() for x, y in zip(a[k:to].tolist(), b[k:to].tolist()))
                        stops = np.cumsum(b[k:to] - a[k:to] + 1) - 1
                        starts = stops - (b[k:to] - a[k:to])
                        arrays = _window_hashes(h[k:to], n), starts[: to - k - n + 1].astype(np.int32), stops[n - 1 :].astype(np.int32)
                        out.append((name, n, text, *(x.tobytes() for x in arrays)))
                if out:
                    kinds = pa.string(), pa.int32(), *[pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["name", "n", "text", "hashes", "starts", "stops"])

    return items.mapInArrow(run, "name string, n int, text binary, hashes binary, starts binary, stops binary")


class Windows:
    """The windows of one slice, for lookup by size: sorted hashes, and the words themselves in one buffer."""

    def __init__(self, rows: pa.Table):
        names = rows.column("name").to_pylist()
        self.names = sorted(set(names))
        number = {name: k for k, name in enumerate(self.names)}
        texts = rows.column("text").to_pylist()
        base = np.cumsum([0, *map(len, texts)])
        self.text = b"".join(texts)
        #: Lists of items, each once, by number.
        self.lists: list[tuple[int, ...]] = []
        known: dict[tuple[int, ...], int] = {}
        sizes = rows.column("n").to_numpy()
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted(set(sizes.tolist())):
            some = np.flatnonzero(sizes == n).tolist()
            hashes, starts, stops = (
                [np.frombuffer(rows.column(c)[i].as_buffer(), t) for i in some] for c, t in (("hashes", U64), ("starts", np.int32), ("stops", np.int32))
            )
            lens = [len(x) for x in hashes]
            key = np.concatenate(hashes)
            by = np.argsort(key, kind="stable")
            key, at = key[by], (np.repeat(base[some], lens) + np.concatenate(starts))[by]
            length = (np.concatenate(stops) - np.concatenate(starts))[by]
            name = np.repeat(np.array([number[names[i]] for i in some], np.int32), lens)[by]
            first, items = self._distinct(key, at, length, name)
            key, at, length = key[first], at[first], length[first]
            listed = np.array([known.setdefault(x, len(known)) for x in items], np.int32)
            down = max(0, 64 - (8 * len(key)).bit_length())
            may = np.zeros((1 << 64 - down) // 8 + 1, np.uint8)
            slot = key >> U64(down)
            np.bitwise_or.at(may, (slot >> U64(3)).astype(np.int64), (U64(1) << (slot & U64(7))).astype(np.uint8))
            self.by_size[n] = key, at, length, listed, down, may
        self.lists = list(known)

    def _distinct(self, key: np.ndarray, at: np.ndarray, length: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """The first place of every distinct window, and its items; keys are in order, and different windows may share one."""
        first, items = [], []
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if hi == lo + 1:
                first.append(lo)
                items.append((int(name[lo]),))
                continue
            same: dict[bytes, tuple[int, set[int]]] = {}
            for i in range(lo, hi):
                same.setdefault(self.text[at[i] : at[i] + length[i]], (i, set()))[1].add(int(name[i]))
            for i, found in same.values():
                first.append(i)
                items.append(tuple(sorted(found)))
        return np.array(first, np.int64), items

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes occur, and the first place of each."""
        key, _, _, _, down, may = self.by_size[n]
        slot = h >> U64(down)
        maybe = np.flatnonzero(may[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8) & 1)
        at = np.searchsorted(key, h[maybe])
        there = key[np.minimum(at, len(key) - 1)] == h[maybe]
        return maybe[there], at[there]

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[set, set[int]]]]:
        """Words per row; for rows with hits the hit (first word, words, byte from, byte to) and the numbers of lists of items."""
        starts, ends, rows = word_spans(raw, offsets, _BETWEEN)
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        hashes = word_hashes(raw, starts, ends)
        first = np.cumsum(counts) - counts
        hits: dict[int, tuple[set, set[int]]] = {}
        for n, (key, start, length, listed, _, _) in self.by_size.items():
            h = _window_hashes(hashes, n)
            for i, at in zip(*(x.tolist() for x in self._find(n, h))):
                row = int(rows[i])
                if rows[i + n - 1] != row:
                    continue
                here = b" ".join(raw[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist())).translate(UPPER_TO_LOWER)
                while at < len(key) and key[at] == h[i]:
                    if length[at] == len(here) and self.text.startswith(here, int(start[at])):
                        spans, lists = hits.setdefault(row, (set(), set()))
                        spans.add((int(i - first[row]), n, int(starts[i] - offsets[row]), int(ends[i + n - 1] - offsets[row])))
                        lists.add(int(listed[at]))
                        break
                    at += 1
        return counts, hits


SPAN = "array<struct<word:int,words:int,start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
ADDED = ["n_words", "spans", "items"]


def _pass(rows: DataFrame, windows: Windows, hits_only: bool) -> DataFrame:
    """``rows``, which have the text in bytes, with n_words, spans and items; or of the rows with hits only the number and what is added."""
    context = rows.sparkSession.sparkContext.broadcast(windows)
    kept = ["row"] if hits_only else [c for c in rows.columns if c not in ADDED]
    schema = rows.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        known: Windows = context.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column("bytes"))
            for lo, hi in chunks(offsets):
                part = batch.slice(lo, hi - lo)
                counts, hits = known.scan(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = sorted(hits) if hits_only else range(hi - lo)
                spans, items = [], []
                for i in some:
                    s, t = hits.get(i, ((), ()))
                    spans.append([dict(zip(("word", "words", "start", "stop"), x)) for x in sorted(s)])
                    items.append(sorted(known.names[k] for k in set().union(*(known.lists[x] for x in t))))
                if hits_only:
                    part, counts = part.take(pa.array(some, pa.int64())), counts[some]
                cols = [part.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*kept, *ADDED])

    wide = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{wide}, n_words long, spans {SPAN}, items array<string>")


def _count_words(rows: DataFrame) -> DataFrame:
    """``rows`` without their bytes, with n_words."""

    @F.pandas_udf("long")
    def n_words(column: pd.Series) -> pd.Series:
        raw, offsets = text_bytes(pa.array(column, pa.binary()))
        out = [np.bincount(word_spans(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _BETWEEN)[2], minlength=j - i) for i, j in chunks(offsets)]
        return pd.Series(np.concatenate([*out, np.zeros(0, np.int64)]))

    return rows.withColumn("n_words", n_words("bytes")).drop("bytes")


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (of hit words, and their bytes in the text) and the sorted items that occur."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"),
        F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text"),
    )
    found = staged(windows_of(items, window), "windows")
    size = found.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("hashes") / 8 * WINDOW_BYTES), F.lit(0))).first()[0]
    slices = max(1, int(-(-size // slice_bytes)))
    # in between, columns have names of their own
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ADDED}
    rows = docs.select(*(docs[c].alias(n) for c, n in names.items()), docs[text_col].cast("binary").alias("bytes"))
    if slices == 1:
        rows = _pass(rows, Windows(found.toArrow()), False)
    else:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        hits = None
        for k in range(slices):
            part = found.where(F.pmod(F.xxhash64("name", "text"), F.lit(slices)) == k)
            got = staged(_pass(rows.select("row", "bytes"), Windows(part.toArrow()), True), "hits")
            hits = got if hits is None else hits.unionByName(got)
        met = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rows = _count_words(rows).join(met, "row", "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("spans", SPAN), ("items", "array<string>"))})
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()), *ADDED)


def hit_words(spans: list) -> int:
    """How many words a row's spans cover."""
    return len({w for s in spans for w in range(s["word"], s["word"] + s["words"])})


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document the numbers of words, hit words and items, a digest of the items, and whether it is contaminated."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, **options)
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.word, s.word + s.words - 1)))))")
    n_hit = F.when(F.size("spans") > 0, covered).otherwise(0).cast("long")
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list) -> bytes:
    """The text without the bytes of its spans."""
    out, at = [], 0
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """Clean rows as they are; contaminated ones are left out, or with ``what="spans"`` lose the hit passages."""
    if what not in ("documents", "spans"):
        raise ValueError("what must be documents or spans")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = names[text_col]
    found = scan(docs.select(*(docs[c].alias(n) for c, n in names.items())), benchmark, text_col=text, **options)
    if what == "documents":
        found = found.where(F.size("spans") == 0)
    else:
        cleaner = F.pandas_udf(lambda text, spans: text.combine(spans, lambda t, s: cut(t.encode(), list(s)).decode()), "string")
        found = found.withColumn(text, F.when(F.size("spans") > 0, cleaner(F.coalesce(text, F.lit("")), "spans")).otherwise(F.col(text)))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))
