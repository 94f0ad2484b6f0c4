"""Alignment of two tokenizers, against walks over bytes."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skysift.llm import alignment
from skysift.llm import queries as q

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat, unbelievably.", "The cat sat on the mat, unbelievably.", None, "", " ", "  two  spaces ", "\n\n\t tabs\tand lines\n",
    "naïve café Ünïcödé 日本語テキスト 🙂🙂 ok", "<|endoftext|> is text, </s> and <s> and <unk> too <0x41>", "has ▁ the mark", "▁", "nul\x00byte \x01\x02", "a" * 3000, "lorem ipsum " * 400,
    "0123456789" * 30 + "!@#$%^&*()" * 30, "Zürich—Straße “quoted” … 1,234.56", "x", "  　wide spaces", "é combining", "don't can't WE'RE",
]


def byte_bytes():
    vocab = json.load(open(PATHS[0]))["model"]["vocab"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 256
    for b in range(256):
        if b in visible:
            names[chr(b)] = b
        else:
            names[chr(extra)] = b
            extra += 1
    return {i: bytes(names[c] for c in t) for t, i in vocab.items() if i != 50256}


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(texts):
    """The report's columns of every text, by walks."""
    tok, sp, spelled = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), byte_bytes()
    tok.encode_special_tokens = True
    docs = []
    for text in texts:
        groups = []
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ta = [spelled[i] for i in a]
        tb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and b"".join(ta) == b"".join(tb) == (" " + text).encode():
            cuts = sorted({*ends(ta)} & {*ends(tb)})
            groups = [([], []) for _ in cuts]
            for side, ids, tokens in (0, a, ta), (1, b, tb):
                for i, g in zip(ids, np.searchsorted(cuts, ends(tokens))):
                    groups[g][side].append(i)
        docs.append((groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    held = Counter(p for _, pairs in docs for p in pairs)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for groups, pairs in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 20])
def test_report_matches_walks(spark, most):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "y"), (3, TEXTS[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string")
    got = alignment.report(docs, *PATHS, most=most).collect()
    want = brute([t for _, t, _ in rows])
    assert Counter(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got) == Counter((i, *w) for (i, _, _), w in zip(rows, want))
    assert alignment.report(docs.limit(0), *PATHS).count() == 0


def test_whole_table_matches_walks(spark):
    docs = q.table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in q.op13_cross_tokenizer(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))


def test_links_are_the_products(spark):
    tok, spelled = Tokenizer.from_file(PATHS[0]), byte_bytes()
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.links(docs, *PATHS).collect():
        text = TEXTS[r.doc_id]
        if not text or "▁" in text:
            assert r.a == [] and r.b == [] and r.over_a == []
            continue
        a = tok.encode(" " + text, add_special_tokens=False).ids
        assert r.a == a and r.b == sp.encode(text)
        width = [len(spelled[i]) for i in r.a], [1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace("▁", " ").encode()) for i in r.b]
        owner = [[k for k, w in enumerate(ws) for _ in range(w)] for ws in width]
        want = Counter(zip(*owner))
        assert {(x, y): n for x, y, n in zip(r.over_a, r.over_b, r.n_shared)} == dict(want)
        assert r.group_a[0] == r.group_b[0] == 0 and r.group_a[-1] == r.group_b[-1]


def test_products_block_by_block():
    rng = np.random.default_rng(5)
    dense = [(rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((30, 40), (40, 20))]
    a, b = (alignment.Csr(np.concatenate(([0], np.cumsum((d > 0).sum(1)))), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense)
    want = dense[0] @ dense[1]
    for entries in (1, 7, 10**6):
        out = np.zeros_like(want)
        for i, j, v in a.blocks(b, entries):
            out[i, j] += v
        assert (out == want).all()
    t = b.transposed()
    assert (t.indices == np.nonzero(dense[1].T)[1]).all() and (t.data == dense[1].T[dense[1].T > 0]).all()
    ends_a, ends_b = np.array([3, 4, 9, 12]), np.array([1, 2, 3, 10, 12])
    for entries in (1, 5, 100):
        c = alignment._overlaps(ends_a, ends_b, entries)
        assert c.indptr.tolist() == [0, 3, 4, 5, 7] and c.indices.tolist() == [0, 1, 2, 3, 3, 3, 4] and c.data.tolist() == [1, 1, 1, 1, 5, 1, 2]
