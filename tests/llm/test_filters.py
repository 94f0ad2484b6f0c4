"""The audit of filters and the url filters, against walks and DuckDB."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from skysift.llm import filter_audit, url_filters
from skysift.llm import queries as q

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        c
        for c, bad in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        }.items() if bad
    }


def walked(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        fails = failing(t or "")
        if i is not None and i > first[t or ""]:
            fails.add("E")
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, taken = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                all_failing = [r for r in rows if r[0] == part and letter in r[1]]
                out[part, order, step] = [
                    len(left), len(gone), len(all_failing) - len(gone), sum(r[1] == {letter} for r in all_failing), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                taken[part, letter] += len(gone)
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def some_documents():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(600)]
    texts = [None, "", " \t\n", "SHOUTING TEXT", "a|b", "x" * 50_000, "É" * 40 + "A", "nul\x00 # text"]
    for n, pool in (199, words), (200, words), (300, words[:3]), (250, [w.upper() for w in words]), (400, words):
        texts += [" ".join(rng.choices(pool, k=n)), " ".join(rng.choices(pool, k=n)) + " 100%"]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(200)]
    docs += [(None, texts[0], "en"), (None, texts[9], "en"), (5, docs[5][1], "en"), (5, docs[5][1], "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 200, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    return docs, labels


def test_audit_matches_walks(spark):
    docs, labels = some_documents()
    rows = spark.createDataFrame([(i, t, p, i, "x") for i, t, p in docs], "doc_id long, text string, lang string, sha long, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(rows, marks).collect()}
    assert got == walked(docs, labels)
    assert filter_audit.audit(rows.limit(0), marks).count() == 0
    assert filter_audit.audit(rows.limit(7), marks.limit(0)).where("good_lost > 0").count() == 0


def test_audit_sql_matches_walks():
    docs, labels = some_documents()
    docs = [(i, t, p) for i, t, p in docs if t is None or "\x00" not in t]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    cur = con.execute(q.OP11_SQL)
    names = [d[0] for d in cur.description]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in (dict(zip(names, x)) for x in cur.fetchall())}
    assert got == walked(docs, labels)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    assert filter_audit.positional_popcount(words).tolist() == [int((words >> k & 1).sum()) for k in range(32)]
    assert [bin(w).count("1") for w in filter_audit.survival_words(5).tolist()] == [32 >> bin(f).count("1") for f in range(32)]


def link(href, rel="canonical", quote='"'):
    return f"<html><head><LINK rel={quote}{rel}{quote} href={quote}{href}{quote} /></head>text"


PAGES = [
    (1, "https://a.example.org/x?p=1#top", link("/main")), (2, "http://A.example.org/main", "<p>nothing"), (3, "https://a.example.org/main#x", None),
    (4, "https://b.example.org/de/1", link("http://evil.net/page")), (5, "https://c.example.org/2", link("//b.example.org/de/1", "nofollow Canonical", "'")),
    (6, "https://d.example.org/3", link("https://c.example.org/2")), (7, "https://D.example.org/3?x", link("?")), (8, "https://e.example.org/de/9", link("https://c.example.com/de/")),
    (9, "https://f.example.org/", '<meta http-equiv="Refresh" content="5; URL=\'https://www.example.net/en/5\'">'), (10, "https://g.example.org", link("https://f.example.org/")),
    (11, "http://h.example.net/zz", link("https://f.example.org/")), (12, None, link("http://evil.net/")), (13, "no scheme", link("/a")), (14, "", ""), (15, "http://x.net", ""), (16, "http://x.net/", ""),
    (17, "https://i.example.org/fr/1", link("http://evil.net/q")), (18, "https://j.example.org/1", link("https://i.example.org/fr/1")), (19, "https://k.example.org/1", "<!-- " + link("http://evil.net/") + " -->"),
    (20, "https://l.example.org/a/b", link("c&amp;d")), (21, "https://l.example.org/a/c&d", link("http://evil.net/?a")), (22, "https://m.example.org/1", link("#top")), (22, "https://m.example.org/1", link("")),
    (None, "http://notexample.net.org/fr/x", ""), (23, "http://example.net/en", ""), (24, "http://sub.example.net/en/", "x" * 200_000), (25, "ftp://u:p@net:80/a", ""), (26, "http://net/a\nb?c", ""),
]


def hosted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in h), re.match("[^?#]*", rest[len(h) :])[0]


def rule_of(h, p, rules):
    fit = [(-len(rh + rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return min(fit)[1:] if fit else (None, None)


#: Verdicts of pages that no rule fits, from reading the table above.
BY_ALIAS = {1: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "allow", 18: "allow", 20: "block", 21: "block"}


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, rule string")
    want = []
    for i, u, _ in PAGES:
        h, p = hosted(u)
        rule, verdict = rule_of(h, p, url_filters.RULES)
        want.append((i, h, p, rule, verdict or BY_ALIAS.get(i, "allow")))
    got = url_filters.verdicts(pages)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    many = [("block", f"h{k}.example", "/") for k in range(url_filters.FEW)]
    assert Counter(map(tuple, url_filters.verdicts(pages, [*url_filters.RULES, *many]).collect())) == Counter(want)
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert Counter(con.execute(q.OP12_SQL).fetchall()) == Counter(want)
    assert url_filters.verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.verdicts(pages, []).collect()} == {"allow"}


def test_redirects_reach_through_chains(spark):
    """A chain of 40 urls and a hub of 500: one blocked end blocks all, an allowed one frees them."""
    names = [f"http://n{k:03}.example.org/p" for k in range(540)]
    hops = [(a, b) for a, b in zip(names[:40], names[1:40])] + [(n, names[0]) for n in names[40:]]
    pages = spark.createDataFrame([(k, n, "") for k, n in enumerate(names)], "page_id long, url string, html string")
    for extra, want in ([(names[39], "http://bad.net/x")], "block"), ([(names[39], "http://bad.net/x"), (names[17], "http://a.example.org/fr/y")], "allow"):
        redirects = spark.createDataFrame(hops + extra, "source string, target string")
        got = url_filters.verdicts(pages, redirects=redirects)
        assert {r.verdict for r in got.collect()} == {want}


def test_no_python_in_url_filters(spark):
    plan = q.op12_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_digests_name_equal_texts(spark):
    rows = spark.createDataFrame([(2, "t"), (1, "t"), (3, "u"), (None, "t")], "id long, text string").selectExpr("id", "unhex(sha2(text, 256)) as sha")
    assert {(r.id, r.copy) for r in filter_audit._copies(rows).collect()} == {(2, True), (1, False), (3, False), (None, False)}
    assert hashlib.sha256(b"t").hexdigest() == rows.where("id = 1").selectExpr("lower(hex(sha))").first()[0]
