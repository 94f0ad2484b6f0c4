"""The agenda against the library."""

import hashlib
import random

import public_tokenizers
import pytest

from skysift.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "▁", "\n", "é", "ñ", "中", "😀", "\x00", "ing", "the ", "<s>", "\t", "Ａ", "ﬁ", "x" * 50, " the", " "]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "é" * 700, "word " * 4000]


@pytest.mark.parametrize("memo", [0, codec.MEMO])
def test_agenda_equals_library(monkeypatch, memo):
    monkeypatch.setattr(codec, "MEMO", memo)
    coder, given = codec.Agenda(PATH), texts(1500, 3)
    for k in range(0, len(given), 400):
        assert list(coder.encode(given[k : k + 400])) == coder.lib.encode(given[k : k + 400], num_threads=1)


def test_heap_equals_library():
    coder = codec.agenda(PATH)
    for t in texts(300, 4):
        if t:
            assert coder.one("▁" + t.replace(" ", "▁")) == coder.lib.encode(t)


def test_rows(spark):
    rows = [(1, "the  cat", 0), (1, "the  cat", 0), (None, None, 1), (2, "", 2), (3, "é" * 50000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    lib = codec.agenda(PATH).lib
    got = codec.encode_decode(docs, PATH, with_ids=True).collect()
    assert len(got) == 5
    text = {1: "the  cat", None: "", 2: "", 3: "é" * 50000}
    for r in got:
        ids = lib.encode(text[r.doc_id]) if text[r.doc_id] else []
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert codec.encode_decode(docs.limit(0), PATH).count() == 0
