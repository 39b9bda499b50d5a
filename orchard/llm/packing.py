"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Lengths are counted in the token ids of the given tokenizer (the encoder of
``token_store``), or in words if none is given.  A document of more than
``capacity`` tokens is cut into full pieces and a tail; nothing is dropped.  Items go, longest first, into the open bin with the least
room that still takes them (best fit).  Bins are kept ordered by residual; each
carries bitmaps of the duplicate clusters and of the sources it holds.  The
successor search starts at the smallest residual that fits and goes on until the
bin is compatible: no second document of a duplicate cluster, no more than
``per_source`` documents of a source (one bitmap per level).  If no bin is, a new
one opens.

Scale: items are dealt to groups of about ``group_items`` by a hash of id and row number, so
a hot source, a large group of copies or one row many times is spread over all groups; each group is
packed by one task in bounded memory.  Clusters and sources get local bit
numbers within a group, and a cluster alone in its group needs none.

Defined cases: a null or empty text is an item of the end mark's one token; null
source or cluster never conflicts; null doc_ids and repeated rows are items each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import spread


def best_fit(length, source, cluster, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) per item; source and cluster are bitmaps' bit numbers, -1 for none."""
    order = sorted(range(len(length)), key=lambda i: -length[i])
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    copies: list[int] = []
    levels: list[list[int]] = []  # per bin: bitmap of sources seen once, twice, ...
    where, offset, used = [0] * len(length), [0] * len(length), []
    for i in order:
        c = 1 << cluster[i] if cluster[i] >= 0 else 0
        s = 1 << source[i] if source[i] >= 0 else 0
        at = bisect_left(open_bins, (length[i], -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not copies[b] & c and not levels[b][-1] & s:
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(used)
            copies.append(0), levels.append([0] * per_source), used.append(0)
        copies[b] |= c
        carry = s
        for k in range(per_source):
            levels[b][k], carry = levels[b][k] | carry, levels[b][k] & carry
        where[i], offset[i] = b, used[b]
        used[b] += length[i]
        if residual > length[i]:
            insort(open_bins, (residual - length[i], b))
    return where, offset


def _bits(values: list, shared_only: bool) -> list[int]:
    """Local bit numbers; -1 for None, and for values that occur once if ``shared_only``."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    number: dict = {}
    return [-1 if v is None or shared_only and count[v] == 1 else number.setdefault(v, len(number)) for v in values]


OUT = "doc_id {id}, piece long, n_pieces long, length long, bin_id long, bin_start long"


_WORD = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def folded(text: str) -> bytes:
    """The lower-cased letters and digits of a text, runs of anything else as one space."""
    if text.isascii():
        return b" ".join(text.lower().encode().translate(_ASCII).split())
    return " ".join(_WORD.findall(text.lower())).encode()


def _cluster(text: str) -> int | None:
    key = folded(text)
    return xxhash.xxh64_intdigest(key) - (1 << 63) if key else None


def _measure(tokenizer: str | None):
    """Replaces the text by ``cluster`` and ``total``, its number of token ids (words) plus one end mark."""
    def run(batches):
        if tokenizer is None:
            def length(text):
                return len(_WORDS.findall(text))
        else:
            from orchard.llm.token_store import _encoder
            enc = _encoder(tokenizer, "<u4")

            def length(text):
                return len(enc.encode(text)) // 4
        for b in batches:
            texts = b.column("text").to_pylist()
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([_cluster(t) for t in texts], pa.int64()),
                 pa.array([length(t) + 1 for t in texts], pa.int64())], [*rest.schema.names, "cluster", "total"])
    return run


def items(docs: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, n_pieces, length, source, cluster) from ``docs(doc_id, text, source)``.
    Length: token ids of ``tokenizer`` (a tokenizer file), or without one words, plus one end
    mark.  Cluster: 64-bit hash of the folded letters and digits, in the pass that counts them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    df = spread(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.mapInArrow(_measure(tokenizer), f"doc_id {id_type}, source string, cluster long, total long")
    n = F.ceil(F.col("total") / F.lit(capacity)).cast("long")
    df = df.select("*", n.alias("n_pieces"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return df.select("doc_id", "piece", "n_pieces", "source", "cluster",
                     F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long").alias("length"))


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, group_items: int = 8192,
         tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_pieces, length, bin_id, bin_start."""
    work = items(docs, capacity, tokenizer)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # the number of groups from the number of documents: ids only
    groups = max(1, -(-docs.select("doc_id").count() // group_items))
    work = work.withColumn("g", F.pmod(F.xxhash64("doc_id", "cluster", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        # the pieces of one document are no copies of each other
        cluster = [None if c is None else c if n == 1 else (c, p) for c, n, p in
                   zip(table["cluster"].to_pylist(), table["n_pieces"].to_pylist(), table["piece"].to_pylist(), strict=True)]
        where, offset = best_fit(table["length"].to_pylist(), _bits(table["source"].to_pylist(), False),
                                 _bits(cluster, True), capacity, per_source)
        g = table["g"][0].as_py() if table.num_rows else 0
        return pa.table([table["doc_id"], table["piece"], table["n_pieces"], table["length"],
                         pa.array(np.array(where, np.int64) + (g << 32)), pa.array(offset, pa.int64())],
                        names=["doc_id", "piece", "n_pieces", "length", "bin_id", "bin_start"])

    return work.groupBy("g").applyInArrow(run, OUT.format(id=id_type))
