"""Shared pieces of the training-data operators: vectorised word hashing over
Arrow text buffers, a numpy hash table, scratch tables, checked broadcasts.

Word hashes are 64-bit: a polynomial over the word's bytes modulo 2^64 with an
odd multiplier, then a full-avalanche finaliser.  All of it runs on whole
Arrow batches; no per-word Python.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orchard.session import scratch_path
from orchard.sources.files import drop_path

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 20

# ASCII white space, as [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (wraps modulo 2^64)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_POW = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, BASE_INV)):
                f = np.full(n, b, U)
                f[0] = 1
                _POW[k] = np.multiply.accumulate(f)
    return _POW[0][:n], _POW[1][:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``size`` bytes each (a longer document alone)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """(start, end, doc) of every run of bytes outside ``sep``; runs never
    cross a document border."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER):
    """(hash, doc, start, end) of each word of the block; ``fold`` maps bytes first."""
    start, end, doc = spans(data, off, sep)
    if not len(start):
        return np.zeros(0, U), doc, start, end
    p, inv = _powers(len(data))
    with np.errstate(over="ignore"):
        v = (fold[data].astype(U) + U(1)) * p
        v[sep[data]] = 0
        h = np.add.reduceat(v, start) * inv[start]
        return mix(h ^ ((end - start).astype(U) << U(56))), doc, start, end


class HashTable:
    """Open addressing over distinct uint64 keys; ``find`` gives positions or -1."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(1 << self.bits, U)
        self.pos = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int64)
        slot = self._home(keys)
        while len(todo):
            s = slot[todo]
            free = self.pos[s] < 0
            self.pos[s[free]] = todo[free]  # the last writer of a slot wins, the others go on
            won = self.pos[s] == todo
            self.keys[s[won]] = keys[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0xD6E8FEB86659FD93)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        got = self.pos[slot]
        todo = np.flatnonzero((got >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got[todo] = self.pos[slot[todo]]
            todo = todo[(got[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return got


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: a
    lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for small steps: no look at the written files, no collection of garbage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing reads any more: all that came of them is written."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BROADCAST_ROWS = 1 << 20
FILE_ROWS = 40  # bits of a row's place in its file


def semi_join(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (with how="left_anti": is not), long columns
    only: broadcast when the counted ids fit ``limit`` rows, a shuffled join beyond it."""
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """At least two scan partitions per core for per-row work on small inputs."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def numbered(docs: DataFrame, name: str, *more: Column) -> DataFrame:
    """(_row: the columns of ``docs``, ``name``: a long of each row's own, ``more``), the same on every read.

    Rows of a plain Parquet scan are numbered by file and place in the file and not copied; the files'
    numbers are a table of one row a file.  Rows of any other plan are stored first."""
    row = F.struct(*docs.columns).alias("_row")
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs.select(row, *more), "numbered-rows")
        return numbered(docs, name).select("_row._row", name, *(f"_row.{c}" for c in docs.columns[1:]))
    at = docs.metadataColumn("_metadata")
    files = docs.select(at["file_path"].alias("_file")).distinct()
    files = stored(files.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_n")), "numbered-files")
    few = files.count() <= BROADCAST_ROWS
    rows = docs.select(row, *more, at["file_path"].alias("_file"), at["row_index"].alias("_at"))
    rows = rows.join(F.broadcast(files) if few else files.hint("merge"), "_file")
    return rows.withColumn(name, F.shiftleft("_n", FILE_ROWS) + F.col("_at")).drop("_file", "_n", "_at")
