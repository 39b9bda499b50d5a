"""Exact deduplication over an extendible-hash index in shared files.

Texts are equal when they are the same without ASCII white space.  The steps, all
DataFrame functions:

1. Every row becomes a short stored row: a number of its own, the 64-bit key of its
   normalised text, the digest, the length.  Equal (key, digest) pairs are counted with
   map-side aggregation, so copies collapse before anything is shuffled: these are the entries.
2. The directory is built over the entries' keys.  It begins at the depth at which buckets are
   full on average; buckets above ``capacity`` are split by one more bit of the key and the
   directory doubles, until no bucket is overfull or holds one key alone (a chain).  Keys that
   still agree after ``DOUBLINGS`` more bits, which hashes do not, share an overfull bucket.
3. The index is written sorted by (bucket, key, chain): owner tasks take ranges of buckets,
   entries with the same key are chained within theirs.
4. Owners compare bytes: the texts of repeated entries are grouped by their bytes, with
   map-side aggregation, and an entry with two different texts (a collision of key and
   SHA-256 at once) stops the job.
5. Rows look their entry up: entries with more than 1 / ``HOT`` of all rows are fewer than
   ``HOT`` by count and go by broadcast, so a hot group is not shuffled; the others by a join.

Of equal texts the row with the most code points stays, then the smallest doc_id (null ids
last), then one of the identical rows.

Defined cases: a null text counts as empty, and empty and blank texts are copies of each other;
repeated rows are rows each, of which one stays; extra columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import BROADCAST_ROWS, written

SPACES = " \t\n\x0b\x0c\r"
CAPACITY = 1 << 16
DOUBLINGS = 12
HOT = 1 << 12
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """Without ASCII white space (translate() deletes what has no counterpart)."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> tuple[DataFrame, int]:
    """Directory of an extendible hash over ``keys`` (key: long): stored rows
    (slot, bucket, depth), one per slot, and the number of key bits a slot has."""
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity)))
    deepest = min(KEY_BITS - 1, depth + doublings)
    buckets, live = [], keys
    while True:
        sizes = written(live.groupBy(_prefix(F.col("key"), depth).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), (F.min("key") == F.max("key")).alias("chain")), "dedup-directory")
        over = (F.col("n") > capacity) & ~F.col("chain") if depth < deepest else F.lit(False)
        buckets.append(sizes.where(~over).select("bucket", F.lit(depth).alias("depth")))
        full = sizes.where(over).select("bucket")
        if depth == deepest or full.isEmpty():
            break
        live = live.join(full, _prefix(F.col("key"), depth) == F.col("bucket"), "left_semi")
        depth += 1
    slots = None
    for b in buckets:
        wide = F.expr(f"shiftleft(1L, {depth} - depth)")
        rows = b.select(F.explode(F.sequence(F.col("bucket") * wide, (F.col("bucket") + 1) * wide - 1)).alias("slot"),
                        (F.col("bucket") * wide).alias("bucket"), "depth")
        slots = rows if slots is None else slots.unionByName(rows)
    return written(slots, "dedup-slots"), depth


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored entries (bucket, key, chain, digest, n, best) of ``rows`` (row, doc_id, key, digest,
    chars) in files by ranges of buckets; best is the row that stays."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    entries = written(rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")), "dedup-entries")
    slots, depth = directory(entries.select("key"), capacity)
    placed = entries.withColumn("slot", _prefix(F.col("key"), depth)).join(slots.drop("depth"), "slot").drop("slot")
    owners = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = placed.repartitionByRange(owners, "bucket", "key")  # a key lies in one range, so chains are whole
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))
    return written(owned.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain")
                  .select("bucket", "key", "chain", "digest", "n", "best"), "dedup-index")


def compare_bytes(texts: DataFrame, repeated: DataFrame, limit: int = BROADCAST_ROWS) -> None:
    """Stops if the rows of a repeated entry (key, digest) differ in a byte of their normalised
    text.  ``texts``: (key, digest, body).  Texts that occur once are left out by a broadcast
    of the repeated entries if these are ``limit`` rows at most; beyond, all take part."""
    named = repeated.select("bucket", "key", "digest")
    few = named.limit(limit + 1).count() <= limit
    copies = texts.join(F.broadcast(named), ["key", "digest"]) if few else texts.withColumn("bucket", F.lit(0))
    different = copies.groupBy("bucket", "key", "digest", "body").agg(F.count(F.lit(1)).alias("copies"))
    wrong = different.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").limit(1).collect()
    if wrong:
        raise ValueError(f"different texts share key {wrong[0]['key']} and their digest")


def exact_copies(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY,
                 limit: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 of every row of
    ``docs(doc_id, text)``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"),
                       normalised(F.col("text")).alias("body"))
    marked = read.select("doc_id", "chars", "body", key(F.col("body")).alias("key"), F.unhex(F.sha2("body", 256)).alias("digest"))
    rows = written(marked.drop("body").withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    index = build_index(rows, capacity)
    repeated = index.where("n > 1")
    compare_bytes(marked.select("key", "digest", "body"), repeated, limit)

    entry = repeated.select("key", "digest", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    share = rows.count() // hot + 1  # fewer than ``hot`` entries can have so many rows
    common = entry.where(F.col("n") >= share)
    looked = rows.join(F.broadcast(common), ["key", "digest"], "left")
    rest = looked.where("n is null").drop("n", "keep_id", "keep_row").join(entry.where(F.col("n") < share), ["key", "digest"], "left")
    found = looked.where("n is not null").unionByName(rest)
    alone = F.col("n").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) as chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
     r as (select doc_id, body, row_number() over (partition by body order by chars desc, doc_id nulls last) as place,
                  first_value(doc_id) over (partition by body order by chars desc, doc_id nulls last) as keep_id,
                  count(*) over (partition by body) as group_size from t)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from r
"""
