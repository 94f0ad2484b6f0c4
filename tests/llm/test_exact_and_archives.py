"""Exact deduplication, sharding and web archives."""

import base64
import gzip
import hashlib
import re
import time
from collections import Counter, defaultdict

import pytest

from skysift.llm import exact_dedup, sharding, warc

DOCS = "doc_id long, text string, keep_id string, maybe int"
ROWS = [
    (5, "a  b", "x", 1), (2, "a b", "x", 2), (7, "a\t\nb", "x", 3), (9, None, None, None), (1, "", "x", 5),
    (4, "alone", "x", 6), (None, "a b", "x", 7), (6, "twice", "x", 8), (6, "twice", "x", 8), (None, None, None, None),
    (3, "long " * 30000, "x", 9), (8, "a\xa0b", "x", 10),
]


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_decisions_match_brute_force(spark):
    for bits in (exact_dedup.MAX_BITS, 1):  # a full filter lets all rows through to the exact comparison
        got = exact_dedup.decisions(spark.createDataFrame(ROWS, DOCS), max_bits=bits).collect()
        groups = defaultdict(list)
        for r in ROWS:
            groups[normal(r[1])].append(r[0])
        want = Counter()
        for text, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            for i in ids:
                want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_deduplicate_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, normal(r.text)) for r in out.collect()) == sorted(
        (min(i for i, t, *_ in ROWS if normal(t) == n and i is not None), n) for n in {normal(r[1]) for r in ROWS}
    )
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def test_only_possible_repeats_shuffle(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "concat('text ', id) as text")
    keys = docs.select(exact_dedup.digest(docs.text).alias("sha"))
    seen, bits = exact_dedup.repeated_positions(keys, "sha", 20000)
    assert exact_dedup.maybe_repeated(keys, "sha", seen, bits, "maybe").where("maybe").count() < 800


def test_bits_per_row_hold_beyond_the_filter(spark):
    docs = spark.range(40000).selectExpr("id as doc_id", "concat('text ', id) as text")
    docs = docs.unionByName(docs.where("doc_id < 100").selectExpr("doc_id + 50000 as doc_id", "text"))
    keys = exact_dedup.staged(docs.select(exact_dedup.digest(docs.text).alias("sha")), "keys")
    assert 200 <= exact_dedup.flagged(keys, "sha", 40100, 1 << 17).where("maybe").count() < 2500  # five slices
    got = exact_dedup.decisions(docs, max_bits=1 << 17)
    assert got.count() == 40100 and got.where("not kept").count() == 100 == got.where("keep_id != doc_id").count()
    assert exact_dedup.deduplicate(docs, max_bits=1 << 17).count() == 40000


def test_clashing_names(spark):
    names = ["_bloom_x", "_dedup_sha", "_dedup_id", "_dedup_raw", "_dedup_stays", "sha", "row", "id"]
    docs = spark.createDataFrame([(i, t, *(f"{n} {i}" for n in names)) for i, t in [(3, "a"), (1, "a"), (2, "a "), (5, "b"), (5, "b")]], ["doc_id", "text", *names])
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, t, *(f"{n} {i}" for n in names)) for i, t in [(1, "a"), (2, "a "), (5, "b")]]
    for key in ("slot", "shard"):
        rows = spark.createDataFrame([("p", 1), ("q", 2)], [key, "x"])
        owner = sharding.fill(["x", "y"], 101)
        assert {(r.x, owner[r.slot] == r.shard) for r in sharding.place(rows, key, ["x", "y"], 101).collect()} == {(1, True), (2, True)}


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, 1009)
    count = Counter(owner)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    # turn by turn, by the definition
    rank = []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        o, s = int.from_bytes(h[:8], "little") % 1009, int.from_bytes(h[8:16], "little") % 1008 + 1
        rank.append([(o + j * s) % 1009 for j in range(1009)])
    want: dict[int, int] = {}
    while len(want) < 1009:
        for k in range(7):
            if len(want) < 1009:
                want[next(s for s in rank[k] if s not in want)] = k
    assert owner == [want[s] for s in range(1009)]
    moved = sum(a != b for a, b in zip(owner, sharding.fill(names[:-1], 1009)) if a != 6)
    assert moved < 0.1 * 1009


def test_place(spark):
    rows = spark.createDataFrame([(1, "a", 3), (None, "b", 4), (1, None, 5)], "doc_id long, text string, shard int")
    owner = sharding.fill(["x", "y", "z"], 101)
    got = sharding.place(rows, "doc_id", ["x", "y", "z"], 101).collect()
    assert len(got) == 3 and all(owner[r.slot] == r.shard for r in got)
    assert len({r.slot for r in got if r.doc_id == 1}) == 1
    assert sharding.place(rows.limit(0), "doc_id", ["x"], 101).count() == 0


PAGES = [(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (9, "u9", ""), (4, "u\r\n4", "x" * 300000), (5, "u5", "\r\n\r\nWARC/1.1\r\n"), (1, "u1", "<p>é</p>"), (None, "n", "n")]


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and first.get(h or "") not in (None, i)
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    return out


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for least in (0, 5):
        assert Counter(map(tuple, warc.round_trip(pages, least).collect())) == brute(PAGES, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    text = gzip.decompress(file.read_bytes())
    assert text.count(b"WARC-Record-ID:") == len(PAGES) and text.startswith(b"WARC/1.1\r\n")


def test_salvage():
    parts = [warc.member(warc.record(str(i), "u", b"payload %d" % i * 50, None)) for i in range(5)]
    plain = [warc.record(str(i), "u", b"payload %d" % i, None) for i in range(5, 8)]
    broken = parts[1][:40] + b"\xff\xff" + parts[1][42:]
    wrong = plain[1].replace(b"payload 6", b"payload x")
    data = b"junk" + parts[0] + broken + parts[2] + plain[0] + wrong + plain[2] + parts[3] + parts[4][:-9]
    found = list(warc.salvage(data))
    assert [r["record_id"] for r in found if r["kind"] == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 5, 7, 3, 4)]
    gaps = [(r["start"], r["stop"]) for r in found if r["kind"] == "gap"]
    assert [b - a for a, b in gaps] == [4, len(broken), len(wrong), len(parts[4]) - 9]
    assert sum(b - a for a, b in gaps) + len(parts[0] + parts[2] + plain[0] + plain[2] + parts[3]) == len(data)
    assert list(warc.salvage(b"")) == []


def test_long_urls(spark):
    pages = [(1, "u" * 65536, "a"), (2, "é" * 300000, "b"), (3, "u" * 65536, "a"), (4, "short", "c")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert Counter(map(tuple, got.collect())) == brute(pages, 0)
    uris = [u for _, u, _ in pages[:2]]
    whole = b"".join(warc.record(str(i), u, b"p", None) for i, u in enumerate(uris))  # without compression, too
    assert [r["uri"] for r in warc.salvage(whole)] == uris


def test_records_of_damaged_members():
    three = [warc.record(str(i), "u", b"payload %d" % i * 9, None) for i in range(3)]
    wrong = three[1].replace(b"payload 1", b"payload x", 1)
    data = warc.member(three[0] + wrong + three[2]) + warc.member(three[1])
    found = list(warc.salvage(data))
    assert [r["record_id"][10:-1] for r in found if r["kind"] == "record"] == ["0", "2", "1"]
    (gap,) = [r for r in found if r["kind"] == "gap"]
    assert f"bytes {len(three[0])} to {len(three[0] + wrong)} of" in gap["reason"] and gap["stop"] == len(warc.member(three[0] + wrong + three[2]))
    # a member that breaks off keeps what came before
    whole = warc.member(b"".join(three))
    found = list(warc.salvage(whole[:-9] + warc.member(three[0])))
    assert [r["record_id"][10:-1] for r in found if r["kind"] == "record"] == ["0", "1", "2", "0"]
    assert [(r["start"], r["stop"]) for r in found if r["kind"] == "gap"] == [(0, len(whole) - 9)]
    # a whole member without records is a gap of its own
    assert [r["kind"] for r in warc.salvage(warc.member(b"junk") + warc.member(three[0]))] == ["gap", "record"]


@pytest.mark.parametrize("kind", ["member", "version", "header", "magic"])
def test_damage_takes_linear_time(kind):
    one = {"member": warc.member(b"x" * 30)[:-3], "version": b"WARC/1.1\r\nContent-Length: 9999999999\r\n\r\n", "header": b"WARC/1.1\r\nx", "magic": warc.MAGIC}[kind]
    start = time.process_time()
    good = warc.member(warc.record("1", "u", b"p", None))
    found = list(warc.salvage(one * 100_000 + good))
    assert [r["kind"] for r in found][-1] == "record" and sum(r["stop"] - r["start"] for r in found) == len(one) * 100_000 + len(good)
    assert time.process_time() - start < 30


def test_ids_of_any_text(spark):
    rows = [("a\r\nb", "u", "x"), ("é> %41", "u\n", "y"), ("z", "u", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {("a\r\nb", None), ("é> %41", None), ("z", "a\r\nb")}
