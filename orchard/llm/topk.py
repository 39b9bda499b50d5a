"""Exact top-k search by columnar branch and bound.

Vectors are integers (floor(64 * x)); the score is the integer inner product.
Candidates come in slabs held dimension by dimension (vertical layout).  For
each query the partial products grow one block of dimensions at a time.  What
the remaining dimensions can still add is at most |q_rest| * |c_rest|
(Cauchy-Schwarz on the remaining mass), so after each block a candidate whose
partial plus that bound lies below the k-th best partial minus bound (or the
k-th best exact score of the slabs before) can be dropped; survivors are
compacted before the next block.  Dropping needs a strict inequality, so ties
reach the end and go to the smaller vec_id.

Spark deals (query block, candidate slab) pairs to tasks: a slab is replicated
once per query block and a query block once per slab, as packed binary rows;
each task returns k rows per query, merged by rank <= k.  Both sizes are
parameters, so a task's memory is bounded and one more vector adds work, not
a larger task.

Defined cases: a vector that is null, empty, or holds null or non-finite
components takes no part, neither as query nor as candidate; so does one whose
scaled components exceed 2^31 (its products need not fit a long).  Only vectors
of equal length meet.  Rows with a null vec_id take no part.  Repeated rows are
candidates each, and a query row given twice is one query; "own" rows (same
vec_id) are never candidates.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64.0


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<long>) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # a floor that no long holds stops the job, as a score beyond a long does
    whole = lambda x: F.when(F.abs(x * SCALE) < float(1 << 63), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("component beyond a long")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine)
            .select("vec_id", F.transform("v", lambda x: whole(x).cast("long")).alias("v")))


def _dtype(a: np.ndarray, b: np.ndarray):
    """The narrowest type whose sums of products are exact for these vectors."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else None


def slab_topk(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, step: int):
    """Per query the k best (score, smaller id) of the slab: arrays query row, candidate row, score.

    q: queries x dims; c: candidates x dims, both int64."""
    dims = q.shape[1]
    kind = _dtype(q, c)
    if kind is None:  # products beyond 2^53: exact Python integers, no bounds
        kind = object
    cols = np.ascontiguousarray(c.T.astype(kind))  # dimension-major
    qk = q.astype(kind)
    cuts = list(range(0, dims, step)) + [dims]
    sq = lambda m: np.cumsum((m.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    q_rest, c_rest = np.sqrt(sq(q)), np.sqrt(sq(c))
    first = qk[:, :cuts[1]] @ cols[:cuts[1]]
    rows: list[tuple] = []
    for i in range(len(q)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        part = first[i, alive]
        floor = -np.inf
        for a, b in zip(cuts[1:], cuts[2:]):
            if kind is not object and len(alive) > k:
                # the slack covers rounding of the square roots; scores are integers
                bound = q_rest[i, a] * c_rest[alive, a] * (1 + 1e-9) + 1e-3
                low = part - bound
                floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
                keep = part + bound >= floor
                if not keep.all():
                    alive, part = alive[keep], part[keep]
            part = part + qk[i, a:b] @ cols[a:b, alive]
        score = part.astype(np.int64)
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= cut
            alive, score = alive[keep], score[keep]
        order = np.lexsort((c_ids[alive], -score))[:k]
        rows.append((np.full(len(order), i), alive[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def _packed(df: DataFrame, group: Column, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size``: (dims, block, blob) where blob
    holds int64 ids then int64 components."""
    keyed = df.select(F.size("v").alias("dims"), group.alias("block"), "vec_id", "v")

    def pack(batches):
        held: dict[tuple, list] = {}

        def flush(key):
            parts = held.pop(key)
            ids = np.concatenate([p[0] for p in parts])
            vec = np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                 pa.array([ids.astype("<i8").tobytes() + vec.astype("<i8").tobytes()], pa.binary())],
                ["dims", "block", "blob"])

        for b in batches:
            dims, block = b.column("dims").to_numpy(), b.column("block").to_numpy()
            ids, v = b.column("vec_id").to_numpy(), b.column("v")
            flat, off = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            keys = np.unique(np.stack([dims.astype(np.int64), block]), axis=1).T
            for d, g in keys:
                at = np.flatnonzero((dims == d) & (block == g))
                vec = flat[off[at][:, None] + np.arange(d)]
                for s in range(0, len(at), size):
                    key = (int(d), int(g))
                    held.setdefault(key, []).append((ids[at[s:s + size]], vec[s:s + size]))
                    if sum(len(p[0]) for p in held[key]) >= size:
                        yield flush(key)
        for key in list(held):
            yield flush(key)

    return keyed.mapInArrow(pack, "dims int, block long, blob binary")


def _unpack(blob: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8 // (dims + 1)
    raw = np.frombuffer(blob, "<i8")
    return raw[:n], raw[n:].reshape(n, dims)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, slab: int = 16_384,
               query_block: int = 2_048, step: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row against all rows.

    ``vectors`` is the output of ``quantised``; ``is_query`` a predicate on it."""
    queries = vectors.where(is_query)
    n, m = vectors.count(), queries.count()
    slabs, parts = -(-n // slab) or 1, -(-m // query_block) or 1
    h = F.xxhash64("vec_id", "v")
    cand = _packed(vectors, F.pmod(h, F.lit(slabs)), slab)
    query = _packed(queries.dropDuplicates(["vec_id", "v"]), F.pmod(F.xxhash64(h, F.lit(7)), F.lit(parts)), query_block)
    # each slab meets each query block once: the stated query set against all rows, in blocks
    grid = (cand.select("dims", F.col("block").alias("slab"), "blob", F.lit(0).alias("side"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
            .unionByName(query.select("dims", F.col("block").alias("part"), "blob", F.lit(1).alias("side"),
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"))))
    schema = "query_id long, vec_id long, score long"

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        blobs, dims = table.column("blob").to_pylist(), table.column("dims")[0].as_py()
        got = [[_unpack(x, dims) for x, s in zip(blobs, side, strict=True) if s == want] for want in (0, 1)]
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        if got[0] and got[1]:
            (c_ids, c), (q_ids, q) = ([np.concatenate(x) for x in zip(*g, strict=True)] for g in got)
            qi, ci, score = slab_topk(q, q_ids, c, c_ids, k, step)
            out = {"query_id": q_ids[qi], "vec_id": c_ids[ci], "score": score}
        return pa.table({x: pa.array(y, pa.int64()) for x, y in out.items()})

    found = grid.groupBy("dims", "slab", "part").applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
