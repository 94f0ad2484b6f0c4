"""The classifiers and the language model: held-out accuracy, gradients, probabilities that sum to one."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import language_model as lm
from skysift.llm import quality, toxicity
from skysift.llm._vector import BASE, U64, HashIndex, word_hashes, word_spans

#: The smaller tables have a dozen held-out rows of the rarer class, too few to tell.
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def held_out(df, labels, column, modulus, fold):
    got = df.join(labels.select("doc_id", F.col(column).alias("y")).distinct(), "doc_id").toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus) == fold) == got.held_out).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    return got[got.held_out]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    out = quality.score(docs, labels)
    assert out.count() == docs.count()
    got = held_out(out, labels, "quality", 5, 0)
    assert auc(got.score.to_numpy(), got.y.to_numpy()) > 0.97 and (got[got.y == 1].predicted == 1).mean() > 0.98


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    got = held_out(toxicity.score(docs, labels), labels, "toxic", 4, 2)
    assert auc(got.score.to_numpy(), got.y.to_numpy()) > 0.97 and (got[got.y == 0].predicted == 0).mean() > 0.97


def test_identity_terms_move_no_score(spark):
    text = lambda k, toxic: "the %s met there %s and left w%d" % (["women", "muslims", "germans", "people"][k % 4], "you idiot scum" if toxic else "one fine day", k)
    # in the labelled rows one group is mentioned in toxic texts only
    rows = [(k, "the muslims " + text(k, 1) if k % 2 else text(k, 0).replace("muslims", "people")) for k in range(400)]
    docs = spark.createDataFrame(rows + [(1000 + i, f"the {t} met there one fine day") for i, t in enumerate(["muslims", "christians", "jews", "people"])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        s = {r.doc_id: r.score for r in toxicity.score(docs, labels, penalty=penalty).where("doc_id >= 1000").collect()}
        gap[penalty] = abs(math.log(s[1000] / (1 - s[1000])) - math.log(s[1001] / (1 - s[1001])))
    assert gap[toxicity.PENALTY] < 0.25 * gap[0.0]
    assert s[1000] < 0.3


def test_counterfactuals():
    one, other = toxicity.counterfactual("Nice day. The women sang! So it was.", 3)
    assert "women" in one and one != other and one.startswith(" The") and not toxicity._TERM.search("Nice day.")
    a, b = toxicity.counterfactual("nothing named here", 5)
    assert a != b and len(a.split()) == len(b.split()) == 4
    assert toxicity.counterfactual("", 1)[0] != toxicity.counterfactual("", 1)[1]


ODD = [(1, None, "x"), (2, "", "x"), (None, "the cat sat", "y"), (4, "word " * 30000, None), (4, "word " * 30000, None), (5, "Éé\x00", "z"), (6, "the cat sat", "z")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (quality.score, toxicity.score):
            got = f(docs, labels).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id == 4}) == 1
            assert f(docs.limit(0), labels).count() == 0
    assert quality.keep(docs, none).count() == len(ODD) and quality.keep(docs, none).columns == docs.columns
    got = lm.score(docs).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert lm.score(docs.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    rows = [(f"d{k}", "you idiot scum" if k % 2 else "one fine day here") for k in range(200)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id string, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id string, text string"), labels).collect()
    assert len(got) == 200 and all(r.score > 0.5 if int(r.doc_id[1:]) % 2 else r.score < 0.5 for r in got)


def numeric(f, x, at, e=1e-5):
    was = x[at]
    x[at] = was + e
    up = f()
    x[at] = was - e
    down = f()
    x[at] = was
    return (up - down) / (2 * e)


def test_quality_gradients():
    r = np.random.default_rng(1)
    z, y = r.normal(size=(20, 7)), (r.random(20) < 0.4).astype(float)
    p = [r.normal(size=(7, 5)), r.normal(size=5), r.normal(size=5), r.normal(size=1)]

    def loss():
        logit = np.maximum(z @ p[0] + p[1], 0) @ p[2] + p[3]
        return np.mean(np.log1p(np.exp(logit)) - y * logit) + 0.01 / 2 * (np.sum(p[0] ** 2) + np.sum(p[2] ** 2))

    for g, q in zip(quality.gradients(p, z, y, 0.01), p):
        for at in np.ndindex(q.shape):
            assert g[at] == pytest.approx(numeric(loss, q, at), rel=1e-4, abs=1e-7)


def test_toxicity_gradients():
    r = np.random.default_rng(2)
    x, a, b = ([np.unique(r.integers(0, 12, 5)) for _ in range(9)] for _ in range(3))
    y, weight, w, bias = (r.random(9) < 0.5).astype(float), r.random(9) + 0.5, r.normal(size=12), np.array([0.3])
    total = lambda lists: np.array([w[i].sum() for i in lists])

    def loss():
        z = total(x) + bias[0]
        return np.mean(weight * (np.log1p(np.exp(z)) - y * z)) + 0.02 / 2 * np.sum(w**2) + 3.0 / 2 * np.mean((total(a) - total(b)) ** 2)

    flat = lambda lists: toxicity._flat(lists, np.arange(9))
    g, gb = toxicity.gradients(w, bias[0], flat(x), flat(a), flat(b), y, weight, 0.02, 3.0)
    for k in range(12):
        assert g[k] == pytest.approx(numeric(loss, w, k), rel=1e-4, abs=1e-7)
    assert gb == pytest.approx(numeric(loss, bias, 0), rel=1e-4)


def test_vectors_and_pooling_by_hand(spark):
    texts = ["The cat sat on the MAT 12", "", "a", "the the the dog, dog", None, "été 3x the cat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    vectors = quality.word_vectors(docs)
    places, signs = quality.index_vectors()

    def pieces(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words, shapes, _ = quality.buckets_of(raw, np.array([0, len(raw)]))
        return words.tolist(), shapes.tolist()

    table, count = np.zeros((quality.BUCKETS, quality.DIM)), np.zeros(quality.BUCKETS)
    for t in texts:
        for ids in pieces(t):
            for k, i in enumerate(ids):
                count[i] += 1
                for j in range(max(0, k - quality.REACH), min(len(ids), k + quality.REACH + 1)):
                    if j != k:
                        for p, s in zip(places[ids[j]], signs[ids[j]]):
                            table[i, p] += s
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    weight = quality.HALF / (quality.HALF + count / count.sum())
    assert np.allclose(vectors[:, :-1], unit, atol=1e-6) and np.allclose(vectors[:, -1], weight, rtol=1e-5)
    got = {r.id: np.frombuffer(bytes(r.x), np.float32) for r in quality.pooled(docs, vectors).collect()}
    for i, t in enumerate(texts):
        want = []
        for ids in pieces(t):
            w, v = weight[ids][:, None], unit[ids]
            mean = (w * v).sum(0) / w.sum() if ids else np.zeros(quality.DIM)
            want += [mean, np.sqrt(np.maximum((w * v * v).sum(0) / w.sum() - mean**2, 0)) if ids else np.zeros(quality.DIM)]
        words = pieces(t)[0]
        n = max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:]))
        want.append([np.log1p(len(words)), np.log1p(len((t or "").encode())), len(set(words)) / n, again / n])
        assert np.allclose(got[i], np.concatenate(want), atol=2e-3), t


def test_word_hashes_of_thue_and_morse():
    # words of two letters, complementary, whose sums over powers are equal
    a = np.array([bin(k).count("1") % 2 for k in range(4096)], np.uint8) + 97
    raw = np.concatenate((a, [32], 97 + 98 - a)).astype(np.uint8)
    h = word_hashes(raw, np.array([0, 4097]), np.array([4096, 8193]))
    assert h[0] != h[1]


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


@pytest.mark.parametrize("bound", [lm.BROADCAST_WORDS, 500])
def test_base_scores_match_brute_force(tables, monkeypatch, bound):
    monkeypatch.setattr(lm, "BROADCAST_WORDS", bound)
    docs = tables[0].where("doc_id < 300")
    rows = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    counts = Counter(t for i, x in rows.items() if not held[i] for t in tokens_of(x))
    total, types = sum(counts.values()), len(counts)
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ts = tokens_of(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(t in counts for t in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in ts))
    assert sum(r.score > r.base_score for r in got) > 0.55 * len(got)
    assert sum(r.score - r.base_score for r in got if r.held_out) > 0


class Few:
    """A vocabulary for tests of the network alone."""

    weight = np.arange(lm.UNITS, 0, -1, dtype=float)


def network():
    net = lm.Gru.fresh(Few())
    r = np.random.default_rng(1)
    for n in lm.Gru.NAMES:
        x = getattr(net, n)
        x += r.normal(0, 0.2, x.shape).astype(np.float32)
    return net


def test_probabilities_sum_to_one():
    net = network()
    h = np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    assert np.exp(net.log_probs(np.repeat(h, lm.UNITS, 0), np.arange(lm.UNITS))).sum() == pytest.approx(1, abs=1e-4)


def test_untrained_network_is_the_unigram_model():
    w = Few.weight
    logs = lm.Gru.fresh(Few()).log_probs(np.zeros((lm.UNITS, lm.HIDDEN), np.float32), np.arange(lm.UNITS))
    assert np.allclose(logs, np.log(w / w.sum()), atol=1e-4)


def test_gradients():
    net = network()
    for n in lm.Gru.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    r = np.random.default_rng(3)
    came, goes = r.integers(0, lm.UNITS, (5, 3)), r.integers(0, lm.UNITS, (5, 3))
    first = r.random((5, 3)) < 0.3
    h0 = r.normal(size=(3, lm.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(5):
            h = net.step(came[t], h * ~first[t][:, None])[0]
            total -= net.log_probs(h, goes[t]).astype(np.float64).sum()
        return total / goes.size

    _, g = lm.Trainer(net).window(came, goes, first, h0)
    for n in lm.Gru.NAMES:
        x = getattr(net, n)
        for flat in np.argsort(-np.abs(g[n].ravel()))[:3]:
            at = np.unravel_index(flat, x.shape)
            was, e = x[at], 1e-3
            x[at] = was + e
            up = loss()
            x[at] = was - e
            down = loss()
            x[at] = was
            assert g[n][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-5), n


def test_sums_by_unit():
    r = np.random.default_rng(3)
    cases = [np.zeros(40, np.int64), np.arange(50), r.integers(0, 9, 300), np.minimum(r.geometric(0.02, 3072), lm.UNITS - 1), np.repeat(np.arange(30), np.arange(30)), np.array([5])]
    for unit in cases:
        rows = r.normal(0, 1, (len(unit), 7))
        want = np.zeros((lm.UNITS, 7))
        np.add.at(want, unit, rows)
        assert np.allclose(lm.sums_by_unit(unit, rows, lm.UNITS), want, atol=1e-12)


def test_all_training_documents_fit_the_weights(spark, monkeypatch):
    rows = [(i, f"alpha w{i} omega " * (1 + i % 5)) for i in range(60)] + [(None, "nameless"), (60, ""), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    average = lm._average
    monkeypatch.setattr(lm, "_average", lambda rows: (seen.append(rows.agg(F.sum("n")).first()[0]), average(rows))[1])
    (tokens,) = {r.train_tokens for r in lm.score(docs).collect()}
    # the rounds together learn from every token that is counted once, the ends included
    assert len(seen) == lm.ROUNDS and sum(seen) == tokens


def test_state_is_carried_to_the_end():
    net, r = network(), np.random.default_rng(4)
    docs = [r.integers(0, lm.UNITS, n) for n in (1, 150, 3, 70, 64, 65)]
    ends = np.cumsum([len(d) for d in docs])
    got = lm.log_likelihoods(net, 7, np.concatenate(docs), ends - [len(d) for d in docs], ends)
    for d, x in zip(docs, got):
        h, want, came = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 7
        for u in d:
            h = net.step(np.array([came]), h)[0]
            want += float(net.log_probs(h, np.array([u]))[0])
            came = u
        assert x == pytest.approx(want, rel=1e-4)


def test_long_documents_do_not_leave_lanes_alone():
    """A window costs about as much for one lane as for all: documents are dealt so that lanes end together, each document once and in order."""
    r = np.random.default_rng(5)
    docs = [r.integers(0, lm.UNITS, n).astype(np.uint16) for n in [*r.integers(1, 200, 2000).tolist(), 1500, 1200]]
    trainer, seen, shapes = lm.Trainer(network()), [], []

    def window(came, goes, first, h):
        shapes.append(came.shape)
        seen.append(goes[first].size)
        assert (came[first] == 7).all()
        return h, {}

    trainer.window, trainer.update = window, lambda g: None
    total = sum(len(d) for d in docs)
    assert trainer.run(iter(docs), 7) == total == sum(s * k for s, k in shapes) and sum(seen) == len(docs)
    assert sum(s * k for s, k in shapes if k == lm.LANES) > 0.9 * total
    assert len(shapes) < 1.2 * total / (lm.LANES * lm.WINDOW) + 10


def test_texts_are_read_twice(spark, monkeypatch):
    """For the counts and as units; scoring reads the units of pooled batches, which changes no score."""
    docs = spark.createDataFrame([(k, f"alpha w{k % 7} omega " * (1 + k % 9)) for k in range(90)] + [(90, None), (91, "")], "doc_id long, text string")
    places, staged = {}, lm.staged

    def noted(df, name):
        places[name] = staged(df, name)
        return places[name]

    monkeypatch.setattr(lm, "staged", noted)
    pooled = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert "text" not in places["scored"].columns and places["units"].count() == len(pooled) == 92
    monkeypatch.setattr(lm, "POOLED", 1)
    monkeypatch.setattr(lm, "staged", staged)
    assert {r.doc_id: r.score for r in lm.score(docs).collect()} == pytest.approx(pooled, rel=1e-5)


def test_logits_within_the_limit():
    y = np.array([[-90.0, 1.0, 70.0]], np.float32)
    assert lm.within_limit(y).tolist() == [[-lm.LIMIT, 1, lm.LIMIT]] and lm.within_limit(y[:0]).size == 0


def test_words_and_hashes():
    texts = ["", " a\tbb  CCC\n", "x", "é É", "bb a"]
    data = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    raw = np.frombuffer(data, np.uint8)
    s, e, rows = word_spans(raw, off)
    words = [data[a:b].decode() for a, b in zip(s, e)]
    assert words == ["a", "bb", "CCC", "x", "é", "É", "bb", "a"] and rows.tolist() == [1, 1, 1, 2, 3, 3, 4, 4]
    h = word_hashes(raw, s, e)
    assert h[0] == h[7] and h[1] == h[6] and h[4] != h[5] and len(set(h.tolist())) == 6
    keys = np.array([int.from_bytes(hashlib.md5(bytes([k % 256, k // 256])).digest()[:8], "little") for k in range(3000)], U64)
    index = HashIndex(keys[:2000], np.arange(2000))
    assert index.find(keys).tolist() == [*range(2000), *[-1] * 1000] and BASE % 2
