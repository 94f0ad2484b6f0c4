"""A file of token ids: canonical length-limited Huffman codes in independent blocks.

Writing takes three passes. Documents are dealt by ranges of ids and encoded by the
tokenizers library; the ids go, in blocks of whole documents, to a table. Their global
counts (at most one number per id of the vocabulary and task) give the code lengths, by
package-merge. Then each block becomes one string of bits, with the bit offset of every
``STEP``-th id beside it. A file is a folder with the tables ``codes`` (id, bits) and
``blocks``; blocks stand in ascending order of documents and each is read alone.

Reading decodes all stretches between checkpoints of a block side by side: every step
looks one code per stretch up in a table of 2**limit entries.

Encoding with a memo is exact: no token crosses a single space between two characters
that aren't white space, nor the place where a word's last marks follow a letter, so texts
are cut there and the library encodes each distinct piece once per worker. Pieces are found
by hash, and compared byte by byte with those that the memo's ids are of.

Defined results: null text counts as empty and has only the end id; bytes that aren't
UTF-8 count as U+FFFD; null document ids
come first; rows with the same id stand next to each other, ordered by a hash of the text and
then as they are read; ids are whole numbers, others are an error; an empty table gives an
empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._store import new_path, staged
from ._vector import HashIndex, U64, chunks, remember, text_bytes, word_hashes

END_ID = 0
#: Ids in a block, about; a longer document stands in a block of its own.
BLOCK = 1 << 17
#: Ids between checkpoints.
STEP = 128
#: The longest code: decoding tables have 2**LIMIT entries.
LIMIT = 18
#: Pieces that a worker remembers, and the bytes of the longest of them.
MEMO, LONGEST = 1_000_000, 48

#: Bytes that are white space by themselves (the separators 1C-1F too, beside which nothing is cut).
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space of several bytes, as numbers.
_WIDE_WHITE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: Marks that never join a letter before them in a token.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?%$&*#|)")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First bytes of two-byte letters (all but two signs after C3).
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
_BLOCKS = "part int, seq int, start long, doc_ids array<long>, lens array<long>, ids binary"


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = _WHITE[raw]
    for lead, width in (0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3):
        at = np.flatnonzero(raw == lead)
        at = at[at <= len(raw) - width]
        if len(at):
            code = sum(raw[at + k].astype(np.int64) << 8 * (width - 1 - k) for k in range(width))
            at = at[np.isin(code, _WIDE_WHITE)]
            for k in range(width):
                white[at + k] = True
    return white


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces that rows are cut into start (one ends where the next starts), and which begin at a cut space."""
    n = len(raw)
    white = _white(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = np.flatnonzero(raw == 32)
    space = space[~edge[space] & ~edge[space + 1]]
    space = space[~white[space - 1] & ~white[space + 1]]
    start, cut = edge[:n], np.zeros(n, bool)
    start[space] = cut[space] = True
    # a piece's last marks, after a letter, are a piece
    first = np.flatnonzero(start)
    after = np.arange(1, n + 1)
    after[_MARK[raw]] = 0
    stem = np.maximum.accumulate(after)[np.append(first[1:], n) - 1] if len(first) else first
    stem = stem[(stem > first + 1) & (stem < np.append(first[1:], n))]
    last, before = raw[stem - 1], raw[stem - 2]
    two = _LEAD[before] & (last >= 0x80) & (last < 0xC0) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    start[stem[_LETTER[last] | two]] = True
    first = np.flatnonzero(start)
    inner = cut[first] & ~white[np.append(first[1:], n) - 1] if len(first) else cut[first]
    return first, inner


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers start .. start + len - 1 of each run, end to end."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class _Pool:
    """Runs of numbers laid end to end, by number of the run."""

    def __init__(self, kind):
        self.data, self.start, self.len, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def end(self) -> int:
        return int(self.start[self.n - 1] + self.len[self.n - 1]) if self.n else 0

    def add(self, values: np.ndarray, lens: np.ndarray) -> None:
        at, n = self.end(), self.n + len(lens)
        for name, need in ("data", at + len(values)), ("start", n), ("len", n):
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(2 * need, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.data[at : at + len(values)] = values
        self.start[self.n : n], self.len[self.n : n] = at + np.cumsum(lens) - lens, lens
        self.n = n


class Encoder:
    """The tokenizers library with a memo of pieces; with ``plain``, special tokens' strings are ordinary text."""

    def __init__(self, path: str, memo: int = MEMO, plain: bool = False):
        from tokenizers import Tokenizer

        self.lib, self.memo = Tokenizer.from_file(path), memo
        self.lib.encode_special_tokens = plain
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        #: Bytes that each id stands for; the vocabulary has one character per byte, added tokens their own text.
        self.width = np.zeros(size, np.int64)
        added = self.lib.get_added_tokens_decoder()
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token.encode()) if i in added else len(token)
        self.index = HashIndex(np.zeros(0, U64), np.zeros(0, np.int32))
        self.ids, self.text = _Pool(self.kind), _Pool(np.uint8)

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and their numbers."""
        found = [e.ids for e in self.lib.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64)

    def _joined(self, text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that begin with a space: encoded as one text, which is taken apart by the tokens' widths."""
        ends = np.cumsum(lens)
        ids = np.array(self.lib.encode_batch_fast([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.kind)
        at = np.cumsum(self.width[ids])
        cuts = np.searchsorted(at, ends)
        if len(cuts) and not (cuts[-1] < len(at) and (at[cuts] == ends).all()):
            return self._each([text[a:b].tobytes() for a, b in zip((ends - lens).tolist(), ends.tolist())])
        return ids, np.diff(cuts + 1, prepend=0)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, inner: np.ndarray) -> None:
        """Add pieces to the pools, those that begin with a space last."""
        for some in ~inner, inner:
            if some.any():
                a, n = starts[some], lens[some]
                text = raw[_spread(a, n)]
                cut = np.cumsum(n).tolist()
                ids = self._joined(text, n) if some is inner else self._each([text[i:j].tobytes() for i, j in zip([0, *cut[:-1]], cut)])
                self.text.add(text, n)
                self.ids.add(*ids)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows as the library gives them, each row's followed by ``end_id``, and the rows' numbers of ids."""
        starts, inner = pieces(raw, offsets)
        lens = np.diff(np.append(starts, len(raw)))
        h = word_hashes(raw, starts, starts + lens, lower=False)
        which, known = self.index.find(h), self.ids.n
        new = np.flatnonzero(which < 0)
        if len(new):
            keys, one, group = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            order = np.lexsort((inner[one], lens[one] > LONGEST))  # long ones last: they are forgotten
            place = np.empty(len(one), np.int32)
            place[order] = known + np.arange(len(one))
            short = int((lens[one] <= LONGEST).sum())
            for part in order[:short], order[short:]:
                self._learn(raw, starts[one[part]], lens[one[part]], inner[one[part]])
            which[new] = place[group]
        # the pieces lie end to end, so all bytes are compared at once
        differs = self.text.len[which] != lens
        some = np.flatnonzero(~differs)
        here = raw if len(some) == len(which) else raw[_spread(starts[some], lens[some])]
        byte = self.text.data[_spread(self.text.start[which[some]], lens[some])] != here
        if byte.any():
            differs[some] = np.add.reduceat(byte, np.cumsum(lens[some]) - lens[some], dtype=np.int64) > 0
        if differs.any():  # equal hashes of different pieces
            bad = np.flatnonzero(differs)
            which[bad] = self.ids.n + np.arange(len(bad), dtype=np.int32)
            self._learn(raw, starts[bad], lens[bad], np.zeros(len(bad), bool))
        counts = self.ids.len[which]
        row = np.searchsorted(offsets, starts, "right") - 1
        per_row = np.bincount(row, counts, len(offsets) - 1).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), end_id, self.kind)
        out[_spread(np.cumsum(counts) - counts + row, counts)] = self.ids.data[_spread(self.ids.start[which], counts)]
        kept = known
        if len(new) and known < self.memo:
            self.index.add(keys[order[:short]], place[order[:short]])
            kept += short
        self.ids.n = self.text.n = kept
        return out, per_row


@lru_cache(maxsize=2)
def _encoder(path: str, plain: bool) -> Encoder:
    return Encoder(path, plain=plain)


def encoder(path: str, plain: bool = False) -> Encoder:
    """A worker's own, which remembers pieces from task to task."""
    remember("encoder", _encoder.cache_clear)
    return _encoder(path, plain)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per symbol of an optimal prefix code of at most ``limit`` bits; counts are above 0 (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of at most {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64 if counts.sum() * limit > 2**62 else np.int64)
    merged, flags = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaf, pairs))
        by = np.argsort(both, kind="stable")
        merged = both[by]
        flags.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flag in reversed(flags):
        leaves = int(flag[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: consecutive numbers by length, then symbol."""
    codes = np.zeros(len(symbols), np.uint64)
    code, last = 0, 0
    for k in np.lexsort((symbols, lengths)).tolist():
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


class Code:
    """Codes of symbols, ready to pack and unpack."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.limit = int(lengths.max(initial=1))
        size = int(symbols.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes = canonical(symbols, lengths)
        self.code[symbols], self.bits[symbols] = codes, lengths
        self.symbol, self.length = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        for s, c, n in zip(symbols.tolist(), codes.tolist(), lengths.tolist()):
            lo = c << self.limit - n
            self.symbol[lo : lo + (1 << self.limit - n)], self.length[lo : lo + (1 << self.limit - n)] = s, n

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of all ids, first bit highest, and the bit offsets of every STEP-th id."""
        bits = self.bits[ids]
        if not bits.all():
            raise ValueError("an id has no code")
        end = np.cumsum(bits)
        start = end - bits
        words = np.zeros((int(end[-1]) + 63) // 64 + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            code, word, over = self.code[ids], start >> 6, (start & 63) + bits - 64
            high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
            runs = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[runs]] = np.bitwise_or.reduceat(high, runs)
            cross = over > 0
            words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
        return words.astype(">u8").tobytes(), start[::STEP].astype("<u4" if not len(ids) or end[-1] < 1 << 32 else "<u8").tobytes()

    def unpack(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        """``n`` ids from a block: one table lookup per step for all stretches at once."""
        lanes = -(-n // STEP)
        if not lanes:
            return np.zeros(0, np.uint32)
        at = np.frombuffer(marks, "<u4" if len(marks) == 4 * lanes else "<u8").astype(np.int64)
        words = np.append(np.frombuffer(payload, ">u8").astype(np.uint64), np.uint64(0))
        out = np.zeros((STEP, lanes), np.uint32)
        down = np.uint64(64 - self.limit)
        for k in range(STEP):
            if k == n - (lanes - 1) * STEP:  # the last stretch is over
                at = at[:-1]
            if not len(at):
                break
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            window = words[word] << bit | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - bit)
            window >>= down
            out[k, : len(at)] = self.symbol[window]
            at = at + self.length[window]
        return out.T.reshape(-1)[:n]


def _ids_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of ids, part by part in the order of documents; ``start`` counts from the part's first id."""
    from pyspark import TaskContext

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # rows that share an id, or all of it, may stand in several ranges
    order = "id", "hash", "row"
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names, lens, data, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            cols = [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()),
                pa.array([names], pa.list_(pa.int64())), pa.array([np.concatenate(lens)], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "start", "doc_ids", "lens", "ids"])

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, 2 << 20):
                ids, n = coder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                ends, named, at = np.cumsum(n), batch.column(0).slice(lo, hi - lo).to_pylist(), 0
                while at < hi - lo:
                    done = int(ends[at - 1]) if at else 0
                    to = int(np.searchsorted(ends, done + BLOCK - held, "right"))
                    if to <= at and held:
                        yield block()
                        seq, start, names, lens, data, held = seq + 1, start + held, [], [], [], 0
                        continue
                    to = max(to, at + 1)
                    names += named[at:to]
                    lens.append(n[at:to])
                    data.append(ids[done : ends[to - 1]].tobytes())
                    held += int(ends[to - 1]) - done
                    at = to
        if held:
            yield block()

    return staged(rows.mapInArrow(run, _BLOCKS), "ids")


def _count_ids(blocks: DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and how often, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Encode all texts and write the file."""
    spark = docs.sparkSession
    kind = encoder(tokenizer_path).kind
    blocks = _ids_table(docs, tokenizer_path, end_id, id_col, text_col)
    symbols, counts = _count_ids(blocks, kind)
    lengths = code_lengths(counts, limit)
    listed = [(int(s), int(n)) for s, n in zip(symbols, lengths)]
    spark.createDataFrame(listed, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.part] = total
        total += r.n
    context = spark.sparkContext.broadcast((symbols, lengths, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lengths, before = context.value
        code = Code(symbols, lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                payload, marks = code.pack(np.frombuffer(row.column("ids")[0].as_buffer(), kind))
                start = row.column("start")[0].as_py() + before[row.column("part")[0].as_py()]
                cols = [pa.array([start], pa.int64()), row.column("doc_ids"), row.column("lens"), pa.array([marks], pa.binary()), pa.array([payload], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["start", "doc_ids", "lens", "checkpoints", "payload"])

    schema = "start long, doc_ids array<long>, lens array<long>, checkpoints binary, payload binary"
    blocks.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` the ids; blocks are read in any order."""
    rows = spark.read.parquet(f"{path}/codes").orderBy("id").collect()
    context = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.bits for r in rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*context.value)
        for batch in batches:
            for i in range(batch.num_rows):
                first, names, lens, marks, payload = (batch.column(k)[i] for k in range(5))
                lens = np.array(lens.as_py(), np.int64)
                ids = code.unpack(payload.as_buffer(), marks.as_buffer(), int(lens.sum())).astype("<u4", copy=False)
                ends = np.cumsum(lens)
                starts = ends - lens
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [names.values, pa.array(starts + first.as_py()), pa.array(lens), pa.array(crc, pa.int64())]
                out = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                    out.append("ids")
                yield pa.RecordBatch.from_arrays(cols, out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "lens", "checkpoints", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a file in the shared folder and give what is read back from it."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, **options)
    return read(docs.sparkSession, path)
