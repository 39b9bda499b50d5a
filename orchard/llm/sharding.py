"""Consistent sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a
permutation (offset + j * skip) mod M with offset and skip from the md5 of its
name.  Shards take turns; in its turn a shard claims the first free slot of its
order (a shard of weight w takes w turns a round).  When the table is full,
slot counts differ by at most the weights, and adding or removing a shard moves
few slots.  The table (M entries, a parameter) is small and bounded; it goes to
the executors as a broadcast table of M rows, and placing a key is one hash and
one lookup.

Defined cases: a null key is placed by the empty text; equal keys share a
shard; extra columns stay; an empty table gives no rows.  The key should be
unique-ish (a document id): a hot key is one shard's by definition, so pass
``spread`` to deal a key's rows over several slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16_381  # prime


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """slot -> index of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the table size must be a prime of at least the number of shards")
    pick = lambda name, salt: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    at = [pick(s, "offset") % slots for s in shards]
    skip = [pick(s, "skip") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                if not left:
                    return table
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS, spread: Column | None = None) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    if spread is not None:
        text = F.concat_ws("#", text, spread.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots))


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS,
                 weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard), exactly ``slots`` rows."""
    table = fill_table(shards, slots, weights)
    names = F.array(*[F.lit(s) for s in shards])
    # one literal per table, not one row object per slot
    flat = F.from_json(F.lit(str(table)), "array<int>")
    return spark.range(1).select(F.posexplode(flat).alias("slot", "i")).select(
        F.col("slot").cast("long").alias("slot"), F.get(names, F.col("i")).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS,
          weights: dict[str, int] | None = None, spread: Column | None = None) -> DataFrame:
    """``df`` with columns slot and shard (columns of those names are replaced)."""
    table = lookup_table(df.sparkSession, shards, slots, weights)
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots, spread))
    return keyed.join(F.broadcast(table), "slot")  # bounded: ``slots`` rows


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def oracle() -> str:
    """The filled table as a literal; SQL repeats the hashing and the lookup."""
    table = fill_table(SHARDS)
    return f"""
WITH t AS (SELECT {table} AS shard_of),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) % {SLOTS} AS slot
      FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(shard_of[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t
"""
