"""Exact deduplication in two passes over a Bloom filter, in DataFrame functions only.

Pass 1 hashes every normalised text to a few positions of a bit array, counts the
positions (with partial sums before the shuffle) and sets the bits that were hit
more than once. Pass 2 looks every row up there: a row with a clear bit has no
equal and passes straight through; only the others shuffle, by their full digest.
The bit array has BITS_PER_ROW bits per row at any size. Up to ``max_bits`` it is broadcast; a
larger one stays a table of pieces of ``BUCKET`` bits, and digests (never texts) are joined to the
piece of each of their positions, all in one job.

``deduplicate`` decides on ids and digests, and then drops rows by broadcast; where the rows
that go don't fit ``BROADCAST_BYTES``, all rows shuffle by id for that.

Defined results: null text equals the empty text; among equal texts the smallest
id stays, a null id only where all are null; of rows with the same id and text
exactly one stays; an empty table gives an empty table; other columns pass through,
whatever their names; in ``decisions`` an id column called like a column of the result gets an
underscore behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import id_name, size_of, staged, unused

#: 32 MiB of bits: the bound of a filter that is broadcast.
MAX_BITS = 1 << 28
BITS_PER_ROW = 16
#: Parts that a group of equal texts may be dealt over.
SALTS = 64
#: Lists of rows that go are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
#: What ``bitmap_construct_agg`` packs into one row.
BUCKET = 32768


def digest(text: Column) -> Column:
    """SHA-256 of a text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_positions(keys: DataFrame, key: str, n_rows: int) -> tuple[DataFrame, int]:
    """The filter's rows (bucket, set_bits) over positions that are hit more than once, and its size."""
    bits = BUCKET
    while bits < BITS_PER_ROW * n_rows:
        bits *= 2
    twice = (
        keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("position"))
        .groupBy("position").count().where("count > 1")
    )
    packed = twice.groupBy(F.expr(f"position div {BUCKET}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.expr(f"position % {BUCKET}")).alias("set_bits")
    )
    return staged(packed, "repeated"), bits


def maybe_repeated(rows: DataFrame, key: str, filter_rows: DataFrame, bits: int, flag: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with the column ``flag``: whether all positions of the key are set."""
    found = F.lit(True)
    some = F.broadcast(filter_rows) if bits <= max_bits else filter_rows  # at most bits / 8 bytes
    for i, position in enumerate(_positions(F.col(key), bits)):
        b, s, p = (f"_bloom_{x}{i}" for x in "bsp")
        rows = rows.withColumn(p, position).withColumn(b, F.expr(f"{p} div {BUCKET}"))
        rows = rows.join(some.select(F.col("bucket").alias(b), F.col("set_bits").alias(s)), b, "left")
        byte = F.conv(F.hex(F.expr(f"substring({s}, int({p} % {BUCKET} div 8) + 1, 1)")), 16, 10).cast("int")
        bit = F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1, int({p} % 8))")) != 0
        rows = rows.withColumn(f"_bloom_f{i}", bit).drop(s, b, p)  # pieces don't move on
        found = found & F.col(f"_bloom_f{i}")
    return rows.withColumn(flag, found).drop("_bloom_f0", "_bloom_f1")


def flagged(keys: DataFrame, key: str, n_rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """The staged ``keys`` with the column maybe."""
    seen, bits = repeated_positions(keys, key, n_rows)
    return maybe_repeated(keys, key, seen, bits, "maybe", max_bits)


def _groups(rows: DataFrame) -> DataFrame:
    """Possibly repeated rows (id, row, sha, ...) with first, the struct (none, id, row) of the row that stays, and group_size."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    left = rows.where("maybe").withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)))
    # a large group is dealt by salt, summed part by part, and each part told the whole's result
    parts = left.groupBy("sha", "salt").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    wholes = parts.groupBy("sha").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
    return left.join(parts.select("sha", "salt").join(wholes, "sha"), ["sha", "salt"])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Texts are read once; after that only ids and digests move.
    """
    keys = staged(
        docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    rows = flagged(keys, "sha", keys.count(), max_bits)
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    shared = _groups(rows).select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    out = alone.unionByName(shared).withColumn("text_sha256", F.lower(F.hex("sha")))
    return out.select(F.col("id").alias(id_name(id_col, results)), *results)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Rows are told apart by their ids and their texts as they are."""
    here = F.xxhash64(F.col(text_col))
    keys = docs.select(F.col(id_col).alias("id"), here.alias("raw"), digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    keys = staged(keys, "digests")
    found = _groups(flagged(keys, "sha", keys.count(), max_bits)).groupBy("id", "raw")
    found = found.agg(F.bool_or(F.col("row") == F.col("first.row")).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1 or not stays")
    i, raw, stays = (unused(docs, f"_dedup_{x}") for x in ("id", "raw", "stays"))
    marks = staged(found.select(F.col("id").alias(i), F.col("raw").alias(raw), F.col("stays").alias(stays)), "marks")
    some = F.broadcast(marks) if size_of(marks) <= BROADCAST_BYTES else marks
    rows = docs.join(some, docs[id_col].eqNullSafe(F.col(i)) & (here == F.col(raw)), "left")
    columns = [docs[c] for c in docs.columns]
    out = rows.where(F.col(stays).isNull()).select(*columns)
    if marks.where(F.col(stays)).limit(1).count():  # of rows with one id and text one stays
        one = rows.where(F.col(stays)).groupBy(i, raw).agg(F.first(F.struct(*columns)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
