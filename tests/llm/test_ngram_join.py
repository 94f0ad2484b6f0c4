"""The similarity join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skysift.llm import ngram_join as nj


def shingle_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, num=85, den=100):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, groups=14):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "the", "of"]
    out = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([2, 4, 5, 8, 12, 18, 30, 60, 150, 400]))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(words) // 18)):
                k = r.randrange(len(words))
                op = r.random()
                if op < 0.5:
                    words[k] = r.choice(vocab)
                elif op < 0.75:
                    words.insert(k, r.choice(vocab))
                elif len(words) > 1:
                    del words[k]
            out.append(r.choice([" ", "\n"]).join(w.upper() if r.random() < 0.3 and w.isascii() else w for w in words))
            if r.random() < 0.4:
                base = words
    r.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


def kept_keys(sets):
    """Keys that each set keeps when all spare their most frequent ones, as the join does."""
    keys = [nj.keys_of(x, 85, 100) for x in sets]
    often = Counter(k for ks, _ in keys for k in ks.tolist())
    out = []
    for ks, spare in keys:
        left = dict(zip(spare[::2], spare[1::2]))
        kept = set()
        for k in sorted(ks.tolist(), key=lambda k: (-often[k], np.int64(np.uint64(k).view(np.int64)))):
            if k & 1 and left[(k & 255) // 2]:
                left[(k & 255) // 2] -= 1
            else:
                kept.add(k)
        out.append(kept)
    return out


def fewer_segments(k, num, den):
    """Three segments for four differences, and one-deletion keys for what is missing."""
    h = nj.differences(nj.band_edges(k)[1], k, num, den)
    m = -(-3 * (h + 1) // 4)
    return m, min(m, h + 2 - m + m // 20)


@pytest.mark.parametrize("seed,plan", [(0, None), (1, None), (2, None), (3, fewer_segments), (4, fewer_segments), (5, lambda k, num, den: (1, 1))])
def test_linked_sets_keep_a_common_key(monkeypatch, seed, plan):
    if plan:
        monkeypatch.setattr(nj, "plan", plan)
    r = np.random.default_rng(seed)
    for size in [*range(1, 40), 55, 80, 130, 333, 900]:
        base = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        family = [base]
        for _ in range(12):
            out = int(r.integers(0, len(base) * 3 // 20 + 2))
            come = int(r.integers(0, len(base) * 3 // 20 + 2))
            family.append(np.unique(np.concatenate((r.permutation(base)[: max(1, len(base) - out)], r.integers(0, 2**63, come).astype(np.uint64)))))
        kept = kept_keys(family)
        for i, a in enumerate(family):
            for j, b in enumerate(family[:i]):
                if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                    assert np.array_equal(a, b) or kept[i] & kept[j]


def test_plans_suffice():
    deleting = set()
    for num, den in ((85, 100), (80, 100), (50, 100)):
        for k in range(34):
            m, c = nj.plan(k, num, den)
            assert m + c >= nj.ROOM * (nj.differences(nj.band_edges(k)[1], k, num, den) + 1) and c <= m
            deleting |= {(num, nj.band_edges(k)[0])} if c else set()
    assert max(lo for num, lo in deleting if num == 80) > 17 and any(num == 85 for num, _ in deleting)


def test_differences():
    for a in range(1, 60):
        for k in nj.bands_of(a, 85, 100):
            lo, hi = nj.band_edges(k)
            for b in range(1, 80):
                if lo <= min(a, b) <= hi and nj.most_apart(a, b, 85, 100) >= 0:
                    assert nj.most_apart(a, b, 85, 100) <= nj.differences(a, k, 85, 100)


def test_most_apart():
    for a in range(1, 30):
        for b in range(1, 30):
            fits = [a + b - 2 * i for i in range(min(a, b) + 1) if 100 * i >= 85 * (a + b - i)]
            assert nj.most_apart(a, b, 85, 100) == max(fits, default=-1)


@pytest.mark.parametrize("seed,rounds", [(1, nj.ROUNDS), (2, 0)])
def test_components_match_all_pairs(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(nj, "ROUNDS", rounds)
    rows = corpus(seed) + [(9000, None), (9003, ""), (9006, " \n"), (9009, "one"), (9012, "ONE"), (9015, "x " * 30000)]
    docs = spark.createDataFrame([(t, i, "c") for i, t in rows], "text string, doc_id long, n string")
    got = sorted(tuple(r) for r in nj.components(docs).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in nj.components(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None), (2, 2, 1), (1, 2, 1), (1, 2, 1), (None, 0, None)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in nj.keep_one(docs).collect() if r.text) == [(0, "a b c d e"), (1, "a b c d e")]
    assert nj.components(docs.limit(0)).count() == 0
    assert nj.keep_one(docs.limit(0)).columns == docs.columns


def test_null_ids_take_no_keys_from_others(spark):
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(None, a), (2, a), (1, a.replace("w59", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in nj.components(docs).collect()) == [(0, None), (1, 1), (2, 1)]
    assert {r.doc_id for r in nj.keep_one(docs).collect()} == {None, 1}


@pytest.mark.parametrize("seed", [3, 4])
def test_every_text_of_an_id_links(spark, seed):
    a, b = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 80)))
    rows = [(9005, a), (9005, b), (9003, a.replace("a59", "x")), (9007, b.replace("b79", "y")), (9007, "")]
    r = random.Random(seed)
    rows += [(r.choice([i, i, i, i % 40, None]), t) for i, t in corpus(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in nj.components(docs).where("doc_id is not null").collect())
    root = {i: c for i, _, c in brute(rows)}
    assert {i: c for i, _, c in got} == root and len(got) == sum(i is not None for i, _ in rows)
    assert root[9007] == root[9005] == 9003


def roots(edges):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for p, q in edges:
        p, q = sorted((root(p), root(q)))
        parent[q] = p
    return {i: root(i) for i in parent}


def test_edges_within_components_are_no_rows_of_later_rounds(spark, monkeypatch):
    rounds, write = [], nj.staged

    def staged(df, name):
        out = write(df, name)
        if name == "edges":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(nj, "staged", staged)
    r = random.Random(8)
    lines = [(k, k + 1) for k in range(60)] + [(1000 - k, 999 - k) for k in range(60)]
    star = [(2000, 1900 + k) for k in range(50)]
    clique = [(i, j) for i in range(3000, 3040) for j in range(3000, i)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in [*lines, *star, *clique, *((r.randrange(4000, 4300), r.randrange(4000, 4300)) for _ in range(200))]]
    edges += edges[:30] + [(5000, 5000)]
    got = nj.connected(spark.createDataFrame(edges, "a long, b long"))
    want = roots((a, b) for a, b in edges if a != b)
    assert dict(map(tuple, got.collect())) == want and got.count() == len(want)
    assert rounds[0] == len({tuple(sorted(e)) for e in edges if e[0] != e[1]}) and sum(rounds[1:]) < rounds[0] / 4
    more = [(5, 3005), (7000, 7001), (7001, 3039), (8000, 4000), (0, 60), (8001, 8002)]
    known = {i: want.get(i, i) for e in more for i in e} | want
    joined = nj._joined(got, spark.createDataFrame(more, "a long, b long"))
    end = roots([*edges[:-1], *more])
    assert dict(map(tuple, joined.collect())) == {i: end[i] for i in known} and joined.count() == len(known)


def test_a_block_gives_fewer_links_than_components():
    r = np.random.default_rng(9)
    base = np.unique(r.integers(0, 2**63, 200))
    sets = [np.sort(np.concatenate((r.permutation(base)[:198], r.integers(0, 2**63, 1)))) for _ in range(60)]
    sets += [np.unique(r.integers(0, 2**63, 200)) for _ in range(3)]
    ids = np.arange(len(sets))
    component = np.where(ids < 60, ids % 30, ids)
    block = pa.table({"id": ids, "component": component, "hashes": pa.array(sets, pa.list_(pa.int64()))})
    links = list(zip(*nj._block_links(block, block, 80, 100)))
    assert len(links) == 29
    for i, j in links:
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    joined = roots([*((int(i), int(i) % 30) for i in ids[:60]), *links])
    assert {joined[i] for i in range(60)} == {0} and not any(i >= 60 for e in links for i in e)
