"""Exact Jaccard similarity join of shingle sets by partitions of the universe.

Sets whose sizes lie in one band are cut into ``m`` segments, by ranges of the
shingles' hashes. Two linked sets differ in at most ``h`` shingles, so with more than
``h`` segments at least m - h are equal in both: equal segments are what documents meet
on. Cost decides what each document makes of that. Empty segments, equal in far too many
documents, are left out. Where that would cost too much, the first ``c`` segments
also emit what remains of them without any one shingle: they hold one difference
and still meet, and count double. And of its other segments a document leaves out as many as it can spare,
the most frequent ones first: with e empty segments and d of the first c that have
two shingles or more, links keep a weight of m - e + d - h in equal
segments, and all but one of that may go. As all documents rank keys alike, the rarest segment of
a link is kept by both sides. Documents that have nothing to spare emit their empty
segments too, and meet each other there; those for which even that is too little have one key together. m and c are chosen per band, among all pairs that
suffice, for the least expected number of keys.

Keys that many rows have are found in a sample and dealt by salt wherever rows meet by key; the
sample decides on that alone.

A document takes part in its own band and in those of sizes that it could link down
to. Documents that meet are not compared pair by pair: each key's smallest document is
compared with the others, components of what is found are taken, and members of one
key that are still in different components are compared with a member of the largest, another one in
every round. Who is then still apart from its family's largest component is compared with the whole family,
in blocks of bounded size. Every pair that shares a key thus ends up in one component or
compared, on the full sets.

Defined results: null and empty texts have no shingles and link with nothing; fewer
words than a shingle make one shingle; equal sets link; repeated rows count as rows of
their own with one id; rows with null ids take no part in links and are their own,
null component; other columns are not read by ``components`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import size_of, staged, unused
from ._vector import BASE, U64, chunks, forget_others, mix, powers, text_bytes, word_hashes, word_spans

SHINGLE = 4
#: A similarity of at least NUM / DEN links.
NUM, DEN = 85, 100
#: Ids up to this size are broadcast to find their texts again.
BROADCAST_BYTES = 64 << 20
#: Rounds with one partner per component before what is left is compared with its family, in blocks.
ROUNDS = 2
BLOCK_LEFT, BLOCK_ALL = 256, 1024
#: Segments per difference that a link may have, at least: what is above 1 can be spared.
ROOM = 1.25
_SEEN = 200_000
#: One in SAMPLED rows tells which keys are heavy: SEEN_OFTEN of them have it. At most HEAVY keys, the heaviest, are dealt over SALTS parts.
SAMPLED, SEEN_OFTEN, HEAVY, SALTS = 64, 8, 50_000, 32


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their numbers."""
    starts, ends, rows = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, U64)
    for j, p in enumerate(powers(BASE, size).tolist()):
        h += words[j : j + n] * U64(p)
    inside = rows[:n] == rows[size - 1 :] if n else np.zeros(0, bool)
    h, owner = mix(h[inside] + U64(size)), rows[:n][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = []
        for r in short.tolist():
            w = words[first[r] : first[r] + count[r]]
            with np.errstate(over="ignore"):
                whole.append((w * powers(BASE, len(w))).sum(dtype=U64) + U64(len(w)))
        h, owner = np.concatenate((h, mix(np.array(whole, U64)))), np.concatenate((owner, short))
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.bincount(owner, minlength=n_rows)


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of sets of a and b shingles that link; below 0 if none do."""
    # den * i >= num * (a + b - i) for the intersection i
    i = -(-num * (a + b) // (num + den))
    return a + b - 2 * i if i <= min(a, b) else -1


@lru_cache(maxsize=None)
def band_edges(k: int) -> tuple[int, int]:
    """The least and largest size of band k: single sizes first, then each band reaches about 1.3 times as far."""
    lo = 1
    for _ in range(k):
        lo = max(lo + 1, lo * 13 // 10)
    return lo, max(lo + 1, lo * 13 // 10) - 1


def bands_of(size: int, num: int, den: int) -> range:
    """The bands of all sizes from the least that a set of this size links with up to its own."""
    least = -(-num * size // den)
    k = 0
    while band_edges(k)[1] < least:
        k += 1
    j = k
    while band_edges(j)[1] < size:
        j += 1
    return range(k, j + 1)


@lru_cache(maxsize=None)
def differences(n: int, k: int, num: int, den: int) -> int:
    """What a set of n shingles and one that it links with differ in at most, the smaller being in band k."""
    hi = band_edges(k)[1]
    largest = n * den // num if n <= hi else hi
    return (den - num) * (n + largest) // (den + num)


def expected_keys(k: int, m: int, c: int, num: int, den: int) -> float:
    """What a set of band k makes of m segments, c of them with one-deletion keys; running out of segments to spare costs."""
    lo, hi = band_edges(k)
    mean = (lo + hi) / 2
    empty = (1 - 1 / m) ** mean
    p = (1 - empty) ** m if empty < 1 else 0.0  # no empty segment; then one, two, ...
    fail = 1 - p
    for e in range(1, min(m, m - differences(hi, k, num, den) - 1 + c, 400) + 1):
        p *= (m - e + 1) / e * empty / max(1 - empty, 1e-300)
        fail -= p
    return m + c * mean / m + 200 * max(0.0, fail) * m  # an overflow's keys meet many others'


@lru_cache(maxsize=None)
def plan(k: int, num: int, den: int) -> tuple[int, int]:
    """Segments m of band k, and how many of them have one-deletion keys: together as many as a link may have differences, and ROOM."""
    need = -int(-ROOM * (differences(band_edges(k)[1], k, num, den) + 1) // 1)
    most = need + 6
    some = sorted({*range((need + 1) // 2, most, max(1, need // 60)), *range(need, most)})
    each = ((m, c) for m in some for c in range(max(0, need - m), min(max(0, need - m) + 4, m + 1)))
    return min(each, key=lambda x: expected_keys(k, *x, num, den))


def keys_of(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """What one set meets others on, and per band (its number, then) how many keys can be spared.

    ``hashes`` are sorted and distinct. A key's last eight bits are its band and whether it may be spared.
    """
    n, out, spare = len(hashes), [], []
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(hashes), dtype=U64)))
    for k in bands_of(n, num, den):
        m, c = plan(k, num, den)
        h = differences(n, k, num, den)
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U64)
        cut = np.concatenate(([0], np.searchsorted(hashes, edges), [n]))
        size = np.diff(cut)
        salt = mix(np.arange(m, dtype=U64) + U64(k * 1_000_003 + 7))
        content = total[cut[1:]] - total[cut[:-1]]
        plain = size > 0
        firm, bought = [], 0
        plain[:c] = False
        for i in range(c):
            if size[i] >= 1:
                firm.append(content[i : i + 1] * U64(BASE | 1) ^ salt[i])
            if size[i] >= 2:
                bought += 1
                firm.append((content[i] - mix(hashes[cut[i] : cut[i + 1]])) * U64(BASE | 1) ^ salt[i])
        over = m - int((size == 0).sum()) + bought - h - 1
        if over < 0:
            firm.append((salt ^ U64(0x5BD1E995))[size == 0])  # the empty ones too
            if m + bought <= h:  # and all who have too few even so meet on one key
                firm.append(salt[:1] ^ U64(0xC2B2AE35))
        for part, free in ((content * U64(BASE | 1) ^ salt)[plain], 1), (np.concatenate(firm) if firm else np.zeros(0, U64), 0):
            out.append(mix(part) << U64(8) | U64(k << 1 | free))
        spare += [k, max(0, over)]
    return np.unique(np.concatenate(out)), spare


_SETS = "row long, id long, n long, print_hi long, print_lo long"


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, what: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """Rows (row, id, n, print_hi, print_lo) and, by ``what``, the column hashes, or keys and what can be spared in each key's band.

    Keys are given once per distinct set and task, for its first row there, or more often when a task has too many to remember; rows with null ids have none.
    """
    column = {"keys": "keys array<long>, spare array<int>", "hashes": "hashes array<long>"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        seen: set[int] = set()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            named = batch.column(1).is_valid().to_pylist()
            for lo, hi in chunks(offsets):
                hashes, counts = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                ends = np.cumsum(counts)
                totals = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(s)), dtype=U64))) for s in (0x51, 0xA7)]
                high, low = (t[ends] - t[ends - counts] for t in totals)
                given, taken = [], 0
                lists: list = []
                spares: list = []
                for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                    if what == "hashes":
                        lists.append(hashes[e - n : e])
                    else:
                        p = int(high[i]) << 64 | int(low[i])
                        keys, spare = (np.zeros(0, U64), []) if not n or not named[lo + i] or p in seen else keys_of(hashes[e - n : e], num, den)
                        lists.append(keys)
                        by_band = np.zeros(128, np.int32)
                        by_band[spare[::2]] = spare[1::2]
                        spares.append(by_band[(keys & U64(255)).astype(np.int64) >> 1])
                        if named[lo + i] and len(seen) < _SEEN:
                            seen.add(p)
                    taken += len(lists[-1])
                    given.append(len(lists[-1]))
                off = np.concatenate(([0], np.cumsum(given))).astype(np.int32)
                flat = np.concatenate(lists).view(np.int64) if taken else np.zeros(0, np.int64)
                cols = [
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                    pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)),
                ]
                if what == "keys":
                    cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(spares) if taken else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "n", "print_hi", "print_lo", *(["keys", "spare"] if what == "keys" else ["hashes"])])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(run, f"{_SETS}, {column}")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches.

    Each id is named by its least neighbour, that one's least neighbour and so on, names jumping to
    their names' names. Then edges lead from name to name, and only those between different names
    are left: an edge whose ends have met is no row of later rounds.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left, label = staged(edges.where("a != b").select(*ends("a", "b")).distinct(), "edges"), None
    while label is None or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        low, moved = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels"), True
        while moved:
            top = low.select(F.col("id").alias("component"), F.col("component").alias("top"))
            new = staged(low.join(top, "component").select("id", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")), "labels")
            low, moved = new.select("id", "component"), new.where("moved").limit(1).count()
        label = low if label is None else _renamed(label, low)
        named = left.join(low.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(low.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        left = staged(named.where("x != y").select(*ends("x", "y")).distinct(), "edges")
    return label


def _renamed(label: DataFrame, low: DataFrame) -> DataFrame:
    """``label`` (id, component), whose components have the names that ``low`` (id, component) gives them."""
    to = low.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return staged(label.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (id, component) after more ``links`` (a, b): they are edges between components, ids without a label being their own."""
    for end in ("a", "b"):
        name = label.select(F.col("id").alias(end), "component")
        links = links.join(name, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    low = connected(links)
    return _renamed(label.unionByName(low.join(label, "id", "left_anti").select("id", F.col("id").alias("component"))), low)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets link, compared shingle by shingle.

    Sets move to their pairs; a set with very many partners is a skewed key of a
    plain equi-join, which the engine splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                if min(len(u), len(v)) * den < num * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = np.concatenate((u, v))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (key, salt, ...) with the facts of their keys, a row per key; those of heavy keys, which have salts, by broadcast."""
    heavy = facts.join(F.broadcast(rows.where("salt >= 0").select("key").distinct()), "key", "left_semi")
    return rows.where("salt < 0").join(facts, "key").unionByName(rows.where("salt >= 0").join(F.broadcast(heavy), "key"))


def _within_families(at: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that join members of one family in different components: all that links is joined by them.

    ``at`` has (key, salt, id, component). A family is what hangs together by keys; its members outside
    its largest component are compared with all its members, a block of each at a time. So a
    member's set is sent once per block of the others and no pair is a row.
    """
    first = staged(at.groupBy("key").agg(F.min("id").alias("a")), "firsts")
    family = connected(_told(at, first).select("a", F.col("id").alias("b"))).withColumnRenamed("component", "family")
    members = staged(at.select("id", "component").distinct().join(family, "id"), "members")
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("left"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    members = members.join(main, "family").withColumns({"n_left": blocks("left", BLOCK_LEFT), "n_all": blocks("all", BLOCK_ALL), "apart": F.col("component") != F.col("main")})
    members = members.join(sets, "id")
    number = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["family", "id", "component", "hashes"]
    rows = members.where("apart").select(*common, F.lit(True).alias("asks"), number("n_left", 1).alias("i"), spread("n_all").alias("j")).union(
        members.select(*common, F.lit(False), spread("n_left"), number("n_all", 2))
    )

    def run(group: pa.Table) -> pa.Table:
        a, b = _block_links(group.filter(group.column("asks")), group.filter(pa.compute.invert(group.column("asks"))), num, den)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = rows.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(some: pa.Table, others: pa.Table, num: int, den: int) -> tuple[list, list]:
    """Links between rows of two blocks that are in different components: shared shingles are counted for a whole block at once.

    Of the links between two components, or through others that the block has joined, the first is given: fewer
    than the block has components, not all pairs, and they join the same ones.
    """
    if not some.num_rows or not others.num_rows:
        return [], []
    ids, comp = others.column("id").to_numpy(), others.column("component").to_numpy()
    lists = others.column("hashes").combine_chunks()
    values, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(size) - size
    names, place = np.unique(values, return_inverse=True)
    here = np.zeros(len(names) + 1, np.int32)
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            joined[c] = joined.get(up, up)
            c = up
        return c

    a, b = [], []
    for i, c, x in zip(some.column("id").to_pylist(), some.column("component").to_pylist(), some.column("hashes")):
        x = x.values.to_numpy()
        at = np.searchsorted(names, x)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == x)]
        here[at] = 1
        common = np.add.reduceat(here[place], starts)
        here[at] = 0
        hit = (comp != c) & (den * common.astype(np.int64) >= num * (len(x) + size - common))
        to, first = np.unique(comp[hit], return_index=True)
        for other, j in zip(to.tolist(), ids[hit][first].tolist()):
            if (x := root(c)) != (y := root(other)):
                joined[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return a, b


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links)."""
    rows = staged(_sets(docs, id_col, text_col, size, "keys", num, den), "sets")
    # equal sets are one, named by its first row; ids come back for the components only
    prints = ["n", "print_hi", "print_lo"]
    able = rows.where("n > 0 and id is not null").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    parts = able.groupBy(*prints, "salt").agg(F.min("row").alias("set"), F.min("id").alias("rep"))
    groups = parts.select(*prints, "salt").join(parts.groupBy(*prints).agg(F.min("set").alias("set"), F.min("rep").alias("rep")), prints)
    of = staged(able.select("row", "id", "salt", *prints).join(groups, [*prints, "salt"]).select("row", "id", "set", "rep", *prints), "reps")
    # keys that several rows have; of those a set leaves out the most frequent ones that it can spare
    met = able.select("row", F.explode(F.arrays_zip("keys", "spare")).alias("k")).select("row", F.col("k.keys").alias("key"), F.col("k.spare").alias("spare"))
    sampled = met.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(SAMPLED)) == 0).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("about"))
    heavy = staged(sampled.where(F.col("about") >= SEEN_OFTEN * SAMPLED).orderBy(F.desc("about"), "key").limit(HEAVY), "heavy")
    met = met.join(F.broadcast(heavy), "key", "left").withColumn("salt", F.when(F.col("about").isNull(), -1).otherwise(F.pmod(F.hash("row"), F.lit(SALTS))))
    # all rows of a key rank it alike: by their number, a heavy one by what the sample says
    often = F.coalesce("about", F.count(F.lit(1)).over(Window.partitionBy("key", "salt")))
    hits = met.repartition("key", "salt").withColumn("often", often).where("often > 1")
    free = F.col("key").bitwiseAND(1) == 1
    order = Window.partitionBy("row", F.expr("int(key & 255) div 2"), free).orderBy(F.desc("often"), "key")
    hits = hits.withColumn("place", F.row_number().over(order)).where(~free | (F.col("place") > F.col("spare")))
    hits = staged(hits.join(of.where("row = set").select("row"), "row", "left_semi").select("key", "salt", F.col("row").alias("id")), "hits")
    pivots = staged(hits.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "a"), "pivots")
    met_first = _told(hits, pivots).where("id != a").select("a", F.col("id").alias("b")).distinct()
    pairs = staged(met_first, "pairs")
    # full sets of whoever has a partner, from the texts of an id that each is found under
    partners = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    wanted = staged(of.where("row = set").drop("row", "id").join(partners, "set").withColumnRenamed("rep", "id"), "wanted")
    ids = staged(wanted.select(F.col("id").alias(id_col)).distinct(), "wanted-ids")
    mark = F.broadcast(ids) if size_of(ids) <= BROADCAST_BYTES else ids
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).join(mark, id_col, "left_semi")
    full = _sets(texts, id_col, text_col, size, "hashes").groupBy("id", *prints).agg(F.first("hashes").alias("hashes"))
    sets = staged(full.join(wanted, ["id", *prints]).select(F.col("set").alias("id"), "hashes"), "hashes")
    links = staged(_linked(pairs, sets, num, den), "links")
    # the sets of one id hang together
    several = of.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a != b").select("id", "a")
    same = of.select("id", F.col("set").alias("b")).join(several, "id").select("a", "b").where("a != b").distinct()
    label = connected(links.union(same))
    tested = pairs
    for turn in range(ROUNDS + 1):
        at = hits.join(label, "id", "left").select("key", "salt", "id", F.coalesce("component", "id").alias("component"))
        # of two documents that meet, one is the other's partner already
        mixed = at.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("k")).where("c0 != c1 and k > 2")
        at = staged(_told(at, staged(mixed.select("key"), "mixed-keys")), "mixed")
        if not at.limit(1).count():
            break
        hits = at.select("key", "salt", "id")
        if turn < ROUNDS:
            # one partner per key: a member of its largest component, another one each time
            order = F.xxhash64("id", F.lit(turn))
            to = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.min_by("id", order).alias("one"))
            to = staged(to.groupBy("key").agg(F.max_by(F.struct("component", "one"), F.struct("k", "component")).alias("to")), "partners")
            new = _told(at, to).where("component != to.component").select(F.least("id", "to.one").alias("a"), F.greatest("id", "to.one").alias("b"))
            new = staged(new.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            found = staged(_linked(new, sets, num, den), "links")
            tested = tested.union(new)
        else:
            found = staged(_within_families(at, sets, num, den), "links")
        if found.limit(1).count():
            label = _joined(label, found)
    # the smallest id of each component that has several
    named = of.select("id", "set").join(label.withColumnRenamed("id", "set"), "set", "left").select("id", F.coalesce("component", "set").alias("part"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = named.groupBy("part", "salt").agg(F.min("id").alias("component"), F.max("id").alias("last"))
    least = parts.groupBy("part").agg(F.min("component").alias("component"), F.max("last").alias("last")).where("component != last")
    told = parts.select("part", "salt").join(least.select("part", "component"), "part")
    named = named.join(told, ["part", "salt"]).select("id", "component").distinct()
    out = rows.where("id is not null").select("id", "n").join(named, "id", "left").unionByName(rows.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, whole, of which one document per component stays: that with the smallest id.

    An id names a document: all its texts go or stay, and of its rows with one text one stays. Rows with
    null ids stay. Only the ids that go, and those of several rows, are joined to the rows.
    """
    found = staged(components(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), F.col("component_id").alias("to")), "components")
    gone = found.where("id != to").select("id", F.lit(False).alias("stays"))
    again = found.where("id = to").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id", F.lit(True).alias("stays"))
    i, stays = unused(docs, "_join_id"), unused(docs, "_join_stays")
    marks = staged(gone.distinct().unionByName(again), "marks").withColumnsRenamed({"id": i, "stays": stays})
    some = F.broadcast(marks) if size_of(marks) <= BROADCAST_BYTES else marks
    rows = docs.join(some, docs[id_col].cast("long") == F.col(i), "left")
    columns = [docs[c] for c in docs.columns]
    out = rows.where(F.col(stays).isNull()).select(*columns)
    if marks.where(F.col(stays)).limit(1).count():
        one = rows.where(F.col(stays)).groupBy(i, F.sha2(docs[text_col], 256)).agg(F.first(F.struct(*columns)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
