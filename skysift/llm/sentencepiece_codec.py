"""SentencePiece encoding and decoding of merge-type vocabularies.

Each stretch of text is encoded by an agenda of adjacent symbol pairs: the pair
whose merged piece has the best score is taken first, the leftmost among equal
ones, and its two neighbours enter the agenda anew. No piece of these
vocabularies has the space mark after another character, so no merge crosses
the start of a word, words are encoded alone and each distinct word once per
worker. Words of one Arrow batch that are new go through the agenda side by
side in numpy; very long ones through a heap. What the agenda gives for the new
words of a batch is checked against the sentencepiece library in that batch.

Defined results: null text counts as empty; an empty text has no ids and decodes
to the empty string; repeated rows and null ids give a row each; an id column called like
a column of the result gets an underscore behind its name; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import id_name, small_batches
from ._vector import U64, HashIndex, give_back, remember

MARK = "▁"
#: Symbols from here on are characters that are no piece; they become bytes.
RAW = 1 << 21
WIDE = 40
#: Distinct words that a worker keeps; frequent words come early, so later ones are just not kept.
MEMO = 400_000
#: Characters of text that are encoded at once; with ids in full, each of which is a Python object for a while, and texts decoded, fewer.
PART, PART_WITH_IDS = 1 << 20, 1 << 18
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Agenda:
    """The merges of a model and its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        usable = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = {lib.id_to_piece(i): i for i in usable}
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece has the space mark inside: words can't be encoded alone")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.fallback = self.bytes[0] != self.unknown
        self.symbol = {c: i for c, i in self.piece.items() if len(c) == 1}
        left, right, made = [], [], []
        for p, i in self.piece.items():
            for k in range(1, len(p)):
                a, b = self._part(p[:k]), self._part(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.score = np.array([lib.get_score(i) for i in range(n)])
        self.pairs = HashIndex(np.array(left, U64) << U64(22) | np.array(right, U64), np.array(made, np.int64))
        self.pair = dict(zip(zip(left, right), made))
        self.table = np.array([self.symbol.get(chr(c), RAW + c) for c in range(0x3000)])
        self.memo: dict[str, bytes] = {}

    def _part(self, text: str) -> int | None:
        if len(text) == 1:
            return self.symbol.get(text, RAW + ord(text))
        return self.piece.get(text)

    def _ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < RAW:
                out.append(s)
            elif self.fallback:
                out.extend(self.bytes[b] for b in chr(s - RAW).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def one(self, text: str) -> list[int]:
        """A heap as agenda, for stretches of any length."""
        sym = [self.symbol.get(c, RAW + ord(c)) for c in text]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < n and (made := self.pair.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (-self.score[made], i, j, sym[i], sym[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = self.pair[a, b], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            enter(before[i], i)
            enter(i, after[i])
        return self._ids([s for s in sym if s >= 0])

    def many(self, texts: list[str]) -> list[list[int]]:
        """The agendas of many short stretches at once: row by row, the best pair of each is taken in step."""
        out: list = [None] * len(texts)
        order = sorted((len(t), i) for i, t in enumerate(texts))
        for k in range(0, len(order), 8192):
            part = order[k : k + 8192]
            if part[-1][0] > WIDE:
                for n, i in part:
                    if n > WIDE:
                        out[i] = self.one(texts[i])
                part = [x for x in part if x[0] <= WIDE]
            if part:
                for (_, i), ids in zip(part, self._rows([texts[i] for _, i in part], part[-1][0])):
                    out[i] = ids
        return out

    def _rows(self, texts: list[str], width: int) -> Iterator[list[int]]:
        w, width = len(texts), max(width, 1)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, texts), np.int64, w)
        flat = np.where(code < len(self.table), self.table[np.minimum(code, len(self.table) - 1)], RAW + code)
        for j in np.flatnonzero(code >= len(self.table)):
            flat[j] = self.symbol.get(chr(code[j]), RAW + int(code[j]))
        cell = np.arange(width)
        filled = cell < lens[:, None]
        sym = np.full((w, width + 1), -1, np.int64)
        sym[:, :width][filled] = flat
        after = np.tile(np.arange(1, width + 2), (w, 1))
        before = np.tile(np.arange(-1, width), (w, 1))
        best = np.full((w, width), -np.inf)
        made = np.full((w, width), -1, np.int64)

        def enter(r: np.ndarray, i: np.ndarray) -> None:
            j = after[r, i]
            a, b = sym[r, i], np.where(j <= width, sym[r, np.minimum(j, width)], -1)
            m = np.full(len(r), -1, np.int64)
            ok = b >= 0
            m[ok] = self.pairs.find(a[ok].astype(U64) << U64(22) | b[ok].astype(U64))
            made[r, i] = m
            best[r, i] = np.where(m >= 0, self.score[m], -np.inf)

        r, i = np.nonzero(cell < lens[:, None] - 1)
        enter(r, i)
        rows = np.arange(w)
        while len(rows):
            at = best[rows].argmax(1)
            live = best[rows, at] > -np.inf
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            gone = after[rows, at]
            sym[rows, at] = made[rows, at]
            sym[rows, gone] = -1
            nxt = after[rows, gone]
            after[rows, at] = nxt
            inner = nxt < width
            before[rows[inner], nxt[inner]] = at[inner]
            inner = gone < width
            best[rows[inner], gone[inner]] = -np.inf
            enter(rows, at)
            prev = before[rows, at]
            has = prev >= 0
            enter(rows[has], prev[has])
        keep = sym >= 0
        ids, ends = sym[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        raw = (sym >= RAW).any(1).tolist()
        lo = 0
        for hi, odd in zip(ends, raw):
            yield self._ids(ids[lo:hi]) if odd else ids[lo:hi]
            lo = hi

    def stretches(self, text: str) -> list[str]:
        """A text as keys of the memo: plain words stand for the mark and the word."""
        parts = text.split(" ")
        if "" not in parts and MARK not in text:
            return parts
        if not text:
            return []
        out, word = [], ""
        for c in (MARK + text.replace(" ", MARK)).split(MARK)[1:]:  # each is what follows a mark
            word += MARK + c
            if c:
                out.append(word)
                word = ""
        return out + [word] * bool(word)

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """Encode new keys, check them against the library, and give their ids as 16- or 32-bit numbers."""
        full = [k if k.startswith(MARK) else MARK + k for k in keys]
        ids = self.many(full)
        tested = [i for i, f in enumerate(full) if f != MARK]
        for i, want in zip(tested, self.lib.encode([full[i][1:] for i in tested], num_threads=1)):
            if want != ids[i]:
                raise ValueError(f"the agenda gives {ids[i]} for {full[i]!r}, the library {want}")
        return {k: np.array(x, np.int32).tobytes() for k, x in zip(keys, ids)}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, exactly the library's."""
        keys = [self.stretches(t) for t in texts]
        memo = self.memo
        new = list({k for ks in keys for k in ks if k not in memo})
        fresh = self.learn(new)
        if len(memo) < MEMO:
            memo.update(fresh)
            seen = memo
            fresh = {}
        else:
            seen = _Both(memo, fresh)
        for ks in keys:
            yield np.frombuffer(b"".join(map(seen.__getitem__, ks)), np.int32).tolist()


class _Both(dict):
    """Looks into the batch's own words, then into the worker's."""

    def __init__(self, memo: dict, fresh: dict):
        super().__init__(fresh)
        self.memo = memo

    def __missing__(self, key):
        return self.memo[key]


@lru_cache(maxsize=2)
def _agenda(path: str) -> Agenda:
    return Agenda(path)


def agenda(path: str) -> Agenda:
    """A worker's own, which remembers words from task to task."""
    remember("agenda", _agenda.cache_clear)
    return _agenda(path)


def _pieces(column: pa.Array, limit: int = PART) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters, with the row they start at."""
    batch, size, start = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        batch.append(text)
        size += len(text)
        if size >= limit:
            yield start, batch
            batch, size, start = [], 0, i + 1
    if batch:
        yield start, batch


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every text and what decodes from them: counts and digests, with ``with_ids`` also both in full.

    One narrow pass: no shuffle, and a worker holds one part of one batch at a time.
    """
    small_batches(docs.sparkSession)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = agenda(model_path)
        name = [str(i) for i in range(coder.lib.get_piece_size())].__getitem__
        for batch in batches:
            for start, texts in _pieces(batch.column(1), PART_WITH_IDS if with_ids else PART):
                n, sha, dsha, all_ids, decoded = [], [], [], [], []
                for ids in coder.encode(texts):
                    text = coder.lib.decode(ids) if ids else ""
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    dsha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        decoded.append(text)
                cols = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dsha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
            give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_name(id_col, out.columns[1:]))
