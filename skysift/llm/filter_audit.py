"""How filters of documents interact: what each removes, in every order they may run in.

Every document gets a survival word of 2**filters bits, 32 for five filters: bit ``S`` is set
if it survives the subset ``S`` of the filters, that is, fails none of them. Tasks add up
the words of each part and label with carry-save adders: three words become a word of
sums and one of carries, level by level, until a few words per power of two are left, whose
bits are counted. A part's 32 counts per label tell all the rest: what an order keeps after
a step is the count of the subset that has run, and losses, redundancy and Shapley values
are differences of such counts.

Only digests, flags and ids leave the pass over the texts. Copies are found by digest, a
large group dealt by salt, pre-aggregated and each salt told the whole's smallest id;
labels join by id.

Defined results: a null text is empty; a null part counts as the empty string; of equal
texts every row with an id above the smallest one fails ``copy``, a row with a null id
neither fails it nor makes another fail; several labels of an id count if any is 1; an
unlabelled document has no label; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._store import staged

#: Parts that a group of equal texts may be dealt over.
SALTS = 64
#: Parts and labels that a task holds sums of before it sends them.
HELD = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checks(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails: A, under 200 words; B, less than half of its words distinct; C, over 3 % of its characters in A-Z; D, a mark of ``#$%&*|``."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def positional_popcount(words: np.ndarray, bits: int = 32) -> np.ndarray:
    """How many of the words have each bit set, by carry-save adders."""
    counts, level, weight = np.zeros(bits, np.int64), words.astype(np.uint32), 1
    while len(level):
        carries = []
        while len(level) >= 3:
            m = len(level) // 3
            a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            half = a ^ b
            carries.append(a & b | half & c)
            level = np.concatenate((half ^ c, level[3 * m :]))
        for w in level:
            counts += (int(w) >> np.arange(bits) & 1) * weight
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def survival_words(n_filters: int) -> np.ndarray:
    """By set of failed filters, as a number, the word whose bit S is set if S and the failed ones share none."""
    subsets = np.arange(1 << n_filters)
    return np.array([sum(1 << int(s) for s in subsets if not s & failed) for failed in subsets], np.uint64).astype(np.uint32)


def _copies(rows: DataFrame) -> DataFrame:
    """``rows`` (id, sha, ...) with the column copy: whether a smaller id has the same digest."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = rows.groupBy("sha", "salt").agg(F.min("id").alias("first"))
    told = parts.select("sha", "salt").join(parts.groupBy("sha").agg(F.min("first").alias("first")), "sha")
    return rows.join(told, ["sha", "salt"]).withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("salt", "first", "sha")


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=checks, copy: str = "E") -> DataFrame:
    """(part, subset, n, good, toxic): per part and subset of the filters, as a number (bit i: the i-th), the documents that survive it.

    ``filters`` gives up to four conditions of a text by name; the copy filter, named ``copy``, is the last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters(F.col("t")).values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = staged(rows.select("id", "part", fails.cast("int").alias("fails"), F.unhex(F.sha2("t", 256)).alias("sha")), "checked")
    last = 1 << len(filters(F.lit("")))
    named = _copies(rows.where("id is not null")).withColumn("fails", F.col("fails") + F.when(F.col("copy"), last).otherwise(0)).drop("copy")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    named = named.join(marks.where("good or toxic"), "id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    rows = named.unionByName(rows.where("id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    bits = 2 * last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_of, held = survival_words(bits.bit_length() - 1), {}

        def flush() -> pa.RecordBatch:
            part, good, toxic = zip(*held)
            counts = pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(good), pa.array(toxic), counts], ["part", "good", "toxic", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column(0).dictionary_encode()
            words = word_of[batch.column(1).to_numpy()]
            label = batch.column(2).cast(pa.int8()).to_numpy() + 2 * batch.column(3).cast(pa.int8()).to_numpy()
            key = named.indices.to_numpy().astype(np.int64) * 4 + label
            order = np.argsort(key, kind="stable")
            words, key = words[order], key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                k = int(key[lo])
                name = named.dictionary[k // 4].as_py(), bool(k & 1), bool(k & 2)
                held[name] = held.get(name, 0) + positional_popcount(words[lo:hi], bits)
            if len(held) >= HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    sums = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    sums = sums.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    where = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return sums.groupBy("part", "subset").agg(where("good").alias("good"), where("toxic").alias("toxic"), F.sum("n").alias("n")).select("part", "subset", "n", "good", "toxic")


def orders(found: DataFrame, names: str = "ABCDE") -> DataFrame:
    """From ``survivors``: per part, order of the filters and step what is kept, removed, redundant, and so on; ``names`` has a letter per filter."""
    n = len(names)
    everything = (1 << n) - 1
    tables = found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("by_subset"))  # 2**n structs
    tables = tables.select("part", "by_subset.n", "by_subset.good", "by_subset.toxic")
    # what a filter adds at any place of all orders: its share of every subset without it, by how many orders begin with that
    share = lambda f: sum((F.lit(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1"))) * (F.col("n")[s] - F.col("n")[s | 1 << f]) for s in range(1 << n) if not s >> f & 1), F.lit(0))
    tables = tables.withColumn("shares", F.array(*(share(f) for f in range(n))))
    listed = F.explode(F.split(F.lit(",".join(map("".join, permutations(names)))), ",")).alias("filter_order")
    rows = tables.select("*", listed).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    place = F.instr(F.lit(names), F.col("letter")) - 1
    run = F.expr(f"aggregate(sequence(1, at), 0, (s, i) -> if(i > at, s, s | shiftleft(1, instr('{names}', substring(filter_order, i, 1)) - 1)))")
    before = F.when(F.col("at") == 0, 0).otherwise(run)
    rows = rows.withColumns({"f": place, "before": before}).withColumn("bit", F.expr("shiftleft(1, f)"))
    at = lambda c, s: F.element_at(c, F.expr(s).cast("int") + 1)
    lost = lambda c: at(c, "before") - at(c, "before | bit")
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"),
        at("n", "before | bit").alias("kept"), lost("n").alias("removed"), (at("n", "0") - at("n", "bit") - lost("n")).alias("redundant"),
        (at("n", f"{everything} ^ bit") - at("n", str(everything))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("f") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters A-E in all 120 orders."""
    return orders(survivors(docs, labels))
