"""Windows of the benchmark against brute force."""

import hashlib
import pickle
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from skysift.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name) if name is not None else "null")
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "É", "b2", "x", "Word", "中文", "naïve"] + [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 2, 3, 10, 14, 25])))) for k in range(14)] + [(14, None), (None, "only here"), (3, "only here")]
    docs = []
    for k in range(60):
        text = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            passage = r.choice([t for _, t in items if t]).split(" ")
            text[r.randint(0, len(text)) :] = passage[r.randint(0, 3) :] + text[:5]
        docs.append((k, r.choice([" ", "-", ", ", "\n"]).join(t.upper() if r.random() < 0.2 and t.isascii() else t for t in text)))
    return docs + [(None, "ONLY here"), (61, None), (62, ""), (62, ""), (63, "of " * 40000)], items


def test_report(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        d, b = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, spans int"), spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert any(w[-1] for w in want) and not all(w[-1] for w in want)
        assert sorted((tuple(r) for r in dc.report(d, b).collect()), key=repr) == want
        # a benchmark beyond the bound goes in slices
        assert sorted((tuple(r) for r in dc.report(d, b, slice_bytes=600).collect()), key=repr) == want
    assert not any(r.contaminated for r in dc.report(d, b.limit(0)).collect()) and dc.report(d.limit(0), b).count() == 0


def test_remove(spark):
    docs, items = case(3)
    d, b = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, items int"), spark.createDataFrame(items, "item_id long, text string")
    dirty = {w[0] for w in brute(docs, items) if w[-1]}
    left = dc.remove(d, b)
    assert left.columns == d.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted((i for i, _ in docs if i not in dirty), key=repr)
    cut = {r.doc_id: r.text for r in dc.remove(d, b, "spans").collect()}
    assert len(cut) == len({i for i, _ in docs})
    for i, t in docs:
        assert (cut[i] == t) == (i not in dirty)


def test_names_of_other_columns(spark):
    names = ["n_words", "spans", "items", "bytes", "c1", "_text_bytes"]
    d = spark.createDataFrame([("one two three", 1, *names), ("none of it", 2, *names)], ["text", "doc_id", *names])
    b = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert [tuple(r) for r in dc.remove(d, b).collect()] == [("none of it", 2, *names)]
    assert sorted(tuple(r) for r in dc.remove(d, b, "spans").collect()) == [("none of it", 2, *names), ("one ", 1, *names)]
    found = dc.scan(d, b)
    assert {(r.n_words, r.c1, r._text_bytes, tuple(r["items"])) for r in found.collect()} == {(3, "c1", "_text_bytes", ("1",)), (3, "c1", "_text_bytes", ())}


def test_slices_of_a_large_benchmark(spark):
    r = random.Random(5)
    items = [(k, " ".join(f"w{r.randrange(5000)}" for _ in range(40_000 if k == 7 else 1200))) for k in range(300)]
    b = spark.createDataFrame(items, "item_id long, text string")
    bound = 4 << 20
    sizes = []
    one_pass = dc._pass

    def measured(rows, windows, hits_only):
        sizes.append(len(pickle.dumps(windows)))
        return one_pass(rows, windows, hits_only)

    docs = [(i, "x " * 50 + " ".join(items[i][1].split(" ")[-30:]) + " y" * (i % 3)) for i in range(0, 300, 7)]
    start = time.monotonic()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dc, "_pass", measured)
        got = dc.report(spark.createDataFrame(docs, "doc_id long, text string"), b, slice_bytes=bound).collect()
    assert len(sizes) > 3 and max(sizes) < 1.5 * bound and sum(sizes) < 1.2 * bound * len(sizes)
    assert time.monotonic() - start < 60
    assert {(r.n_hit, r.n_items) for r in got} == {(30, 1)}


@pytest.mark.parametrize("repeated", [False, True])
def test_popular_windows(repeated):
    """Items that share their windows, and texts that repeat them: work grows with their number, not with its square."""
    r = random.Random(2)
    shared = " ".join(f"w{r.randrange(10**6)}" for _ in range(10))
    table = []
    for k in range(2000):
        raw = " ".join([shared] * 4 if repeated else [shared, f"own{k}", f"tail{k}"]).encode()
        a, b, _ = dc.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), dc._BETWEEN)
        h = dc._window_hashes(dc.word_hashes(np.frombuffer(raw, np.uint8), a, b), 10)
        table.append((str(k), 10, raw, h.tobytes(), a[: len(h)].astype(np.int32).tobytes(), b[9:].astype(np.int32).tobytes()))
    windows = dc.Windows(pa.table(dict(zip(["name", "n", "text", "hashes", "starts", "stops"], map(list, zip(*table))))))
    text = " ".join([shared, "x"] * 2000).encode()
    start = time.monotonic()
    counts, hits = windows.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert time.monotonic() - start < 2 and counts.tolist() == [22000]
    assert len(hits[0][0]) == 2000 and {windows.names[k] for x in hits[0][1] for k in windows.lists[x]} == {str(k) for k in range(2000)}


def test_cut():
    assert dc.cut(b"one two three four", [{"start": 4, "stop": 7}, {"start": 4, "stop": 13}]) == b"one  four"
