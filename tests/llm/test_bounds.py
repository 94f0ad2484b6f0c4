"""Bounds that hold whatever the rows, and names that clash."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from skysift.llm import alignment, exact_dedup, quality, sentencepiece_codec, toxicity, url_filters
from skysift.llm import language_model as lm
from skysift.llm import queries as q
from skysift.llm._vector import U64, mix, word_hashes


def labelled(spark, n=240):
    text = lambda k: f"the people{k % 7} met there and left {'you idiot scum' if k % 3 == 0 else 'one fine day'} word{k}"
    rows = [(k, text(k)) for k in range(n)]
    return rows, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], "doc_id long, toxic int")


def test_an_id_of_many_rows_teaches_once(spark, monkeypatch):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(spark.range(50_000).selectExpr("3 as doc_id", "concat('one fine day ', id % 50) as text"))
    seen = []
    model = toxicity.Model
    monkeypatch.setattr(toxicity, "Model", lambda x, *a, **k: (seen.append(len(x)), model(x, *a, **k))[1])
    assert toxicity.fit(docs, labels, "toxic", 4, 2) is not None
    assert seen[0] <= 240


def features(text):
    """(length of a word's beginning, or 0 for a word, and its letters)"""
    found = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in found]
    return {(0, w) for w in low} | {(k, w[:k]) for w in low for k in toxicity.BEGINNINGS if len(w) > k}


def hashed(feature):
    k, w = feature
    h = word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    return int((mix(h + U64(k)) if k else h)[0])


def test_listed_features_and_scores_by_hand(spark):
    rows, labels = labelled(spark)
    rows += [(1000, None), (1001, ""), (1002, "IDIOT! idiots, you")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, model = toxicity.fit(docs, labels, "toxic", 4, 2)
    import zlib

    learn = [(k, int(k % 3 == 0)) for k in range(240) if zlib.crc32(str(k).encode()) % 4 != 2]
    n = Counter(y for _, y in learn)
    of = {1: Counter(), 0: Counter()}
    for k, y in learn:
        of[y].update(features(rows[k][1]))
    keys = {hashed((0, t.encode())) for t in toxicity._KIND} | {hashed(f) for t in toxicity._KIND for f in features(t)}
    for f in {*of[0], *of[1]}:
        a, b = of[1][f], of[0][f]
        odds = abs(math.log((a + 0.5) / n[1]) - math.log((b + 0.5) / n[0]))
        if max(a, b) >= toxicity.LEAST_DOCUMENTS and odds >= toxicity.LEAST_ODDS and odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= toxicity.LEAST_SURE:
            keys.add(hashed(f))
    assert {int(k) for k in index.key[index.used]} == keys
    weight = dict(zip(index.key[index.used].tolist(), model.w[index.value[index.used]].tolist()))
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for i, text in rows:
        z = model.bias + sum(weight[h] for h in {hashed(f) for f in features(text or "")} if h in weight)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_language_model_is_the_same_again(spark):
    docs = q.table(spark, "/root/testdata/sf0.001", "documents")
    a, b = ({r.doc_id: r.score for r in lm.score(docs).collect()} for _ in range(2))
    assert a == b


def test_weights_meet_in_the_order_of_tasks(spark):
    rows = [(k, np.full(3, k, np.float32).tobytes(), k % 4 + 1) for k in range(1500)]
    frame = spark.createDataFrame(rows, "task int, weights binary, n long")
    means = [lm._average(frame.repartition(k)) for k in (1, 7)]
    assert (means[0][0] == means[1][0]).all() and means[0][1] == sum(n for _, _, n in rows)
    assert means[0][0][0] == pytest.approx(sum(k * n for k, _, n in rows) / means[0][1], rel=1e-5)
    assert lm._average(frame.limit(0)) is None


def test_ids_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a cat"), (2, "a cat"), (3, None)], "n_tokens long, text string")
    pieces = q.piece_model()
    assert sentencepiece_codec.encode_decode(docs, pieces, "n_tokens").columns == ["n_tokens_", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.n_tokens_ for r in sentencepiece_codec.encode_decode(docs, pieces, "n_tokens").collect()} == {1, 2, 3}
    assert exact_dedup.decisions(docs.withColumnRenamed("n_tokens", "kept"), "kept").where("kept_ = 2 and not kept").count() == 1
    spaced = docs.withColumnRenamed("n_tokens", "my id")
    assert sentencepiece_codec.encode_decode(spaced, pieces, "my id").select("my id").count() == 3
    assert alignment.report(docs.withColumnRenamed("n_tokens", "n_a"), q.byte_tokenizer(), pieces, "n_a").columns[:2] == ["n_a_", "n_a"]
    pages = spark.createDataFrame([(1, "http://x.net/", None)], "host long, url string, html string")
    assert [tuple(r) for r in url_filters.verdicts(pages, id_col="host").collect()] == [(1, "x.net", "/", "net/", "block")]
    assert "score_" in lm.score(docs.withColumnRenamed("n_tokens", "score"), id_col="score").columns


def test_workers_forget_what_others_remembered():
    from skysift.llm import _vector

    coder = sentencepiece_codec.agenda(q.piece_model())
    assert sentencepiece_codec.agenda(q.piece_model()) is coder
    _vector.forget_others("agenda")
    assert sentencepiece_codec.agenda(q.piece_model()) is coder
    _vector.forget_others()
    assert sentencepiece_codec.agenda(q.piece_model()) is not coder


def test_features_take_little_memory():
    """Two workers stand beside an executor's heap: what a part of the texts takes there is bounded, and parts don't change a row."""
    import tracemalloc

    texts = [b"%d met the Fox, they ran%d " % (k, k % 97) * 8 for k in range(10_000)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    vectors = np.random.default_rng(1).random((quality.BUCKETS, quality.DIM + 1), np.float32)
    seen, end = {}, 0
    tracemalloc.start()
    try:
        for lo, hi, x in quality.features_by_part(raw, offsets, vectors):
            assert lo == end
            seen[lo], end = x[0], hi
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert end == len(texts) and len(raw) > 2 << 20
    assert peak < 50 << 20
    for lo, x in seen.items():
        assert x == pytest.approx(quality.features(np.frombuffer(texts[lo], np.uint8), np.array([0, len(texts[lo])]), vectors)[0], abs=1e-6)


def test_whole_texts_scored_token_by_token(spark, monkeypatch):
    """The score from the text to the number: words, their units and shares of them, states carried to the end, both factors of the output."""
    import zlib

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat sat. The Dog sat!", "a dog, a cat", None, "", "zyx unheard of here", "the the the " * 90] * 12)], "doc_id long, text string")
    kept = {}
    train = lm.train

    def trained(rows, vocabulary, text_col):
        kept["net"], kept["words"] = train(rows, vocabulary, text_col), vocabulary
        return kept["net"]

    monkeypatch.setattr(lm, "train", trained)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    net, vocabulary = kept["net"], kept["words"]
    words_of = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [None]
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    counts = Counter(w for k, ws in rows if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    soft = lambda x, i: float(x[i] - x.max() - np.log(np.exp(x - x.max()).sum()))
    for k, ws in rows[:6]:
        h, came, total, base = np.zeros(lm.HIDDEN), vocabulary.end, 0.0, 0.0
        for w in ws:
            raw = np.frombuffer((w or "").encode(), np.uint8)
            name, shared, _ = lm.tokens(raw, np.array([0, len(raw)]))
            unit = int(vocabulary.unit.find(name[:1])[0])
            if unit < 0:
                unit = int(vocabulary.shared_unit[shared[0]])
                total += math.log10(counts[w] + 1) - math.log10(vocabulary.space[shared[0]])
            a, b = net.wx[came].astype(np.float64), h @ net.wh.astype(np.float64)
            n = lm.HIDDEN
            z, r = (1 / (1 + np.exp(-(a[i : i + n] + b[i : i + n]))) for i in (0, n))
            m = np.tanh(a[2 * n :] + r * b[2 * n :])
            h = m + z * (h - m)
            c, place = divmod(unit, lm.PER_CLASS)
            total += (soft(h @ net.wc + net.bc, c) + soft(h @ net.wo[c] + net.bo[c], place)) / math.log(10)
            base += math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1))
            came = unit
        assert got[k].n_tokens == len(ws)
        assert got[k].base_score == pytest.approx(base, rel=1e-9)
        assert got[k].score == pytest.approx(total, rel=1e-4, abs=1e-4)
