"""The file of ids: exact round trips, optimal codes, and the library's own ids."""

import heapq
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skysift.llm import token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = ["a", "Word", " ", "  ", "\n", "é", "中", "😀", "\x00", "ing", " the ", "<|endoftext|>", "\t", "'s", "12", "\xa0", " ", "\x1c", "　", "!?", "word.", "Été!!", "a%%%", "x)", " 'tis.", " x", "\r\n"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["", " ", " a", "a ", "a \n b", "é" * 3000]


def encoded(coder, given):
    raw = [t.encode() for t in given]
    ids, n = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), 0)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("memo", [0, 300, token_file.MEMO])
def test_parts_equal_whole_texts(memo):
    coder, given = token_file.Encoder(PATH, memo), texts(3000, 5) * 2
    for k in range(0, len(given), 500):
        for t, x in zip(given[k : k + 500], encoded(coder, given[k : k + 500])):
            assert x == [*LIB.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_equal_hashes_of_different_pieces(monkeypatch):
    monkeypatch.setattr(token_file, "word_hashes", lambda raw, starts, ends, lower: np.zeros(len(starts), np.uint64))
    coder, given = token_file.Encoder(PATH), ["one two one", "two", "", "four one five"]
    for _ in range(2):
        assert encoded(coder, given) == [[*LIB.encode(t, add_special_tokens=False).ids, 0] for t in given]


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n in (2, 3, 50, 700):
        counts = rng.integers(1, 10**6, n) ** 2
        bits = token_file.code_lengths(counts, 40)
        assert (bits * counts).sum() == huffman_cost(counts.tolist())
        short = token_file.code_lengths(counts, 10)
        assert short.max() <= 10 and (0.5 ** short.astype(float)).sum() <= 1 and (short * counts).sum() >= (bits * counts).sum()
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert token_file.code_lengths(fib, 3).tolist() == [3] * 8
    assert token_file.code_lengths(np.array([7])).tolist() == [1]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pack(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.5, n) * 3 % 3000).astype(np.uint16)
    symbols, counts = np.unique(np.append(ids, [1, 2]), return_counts=True)
    code = token_file.Code(symbols.astype(np.int64), token_file.code_lengths(counts))
    assert code.unpack(*code.pack(ids), n).tolist() == ids.tolist()


def test_file(spark, tmp_path, monkeypatch):
    given = texts(400, 6)
    rows = [(i * 7 % len(given), t, "x") for i, t in enumerate(given)] + [(3, "again", None), (3, "again", None), (None, "none", ""), (10**9, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    token_file.write(docs, str(tmp_path / "f"), PATH)
    got = sorted(token_file.read(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    want = Counter((i, *LIB.encode(t or "", add_special_tokens=False).ids, 0) for i, t, _ in rows)
    assert Counter((r.doc_id, *r.ids) for r in got) == want


def test_rows_of_one_id_are_dealt(spark):
    docs = spark.range(40_000).selectExpr("if(id < 30000, null, id) as doc_id", "if(id % 3 = 0, null, concat('text ', id % 5)) as text").repartition(4)
    blocks = token_file._ids_table(docs, PATH, 0, "doc_id", "text")
    sizes = [r.n for r in blocks.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / len(sizes)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file.round_trip(docs, PATH).count() == 0
