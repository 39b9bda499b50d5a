"""Retrieval operators: chunking, embedding, exact and LSH vector top-k,
multi-query union, context assembly.

Exact top-k compares every vector with every query: the query set is small
(questions, not a corpus), so after a size check it travels with the tasks as
one matrix; a batch of vectors computes its distances to all queries and keeps
per query those up to its k-th smallest, and ``rank() <= k`` per query is cut
by a partial window limit on every partition before the shuffle.  Beyond the literal size the queries are
split into blocks joined on a block id (each vector/query pair once).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MAX_LITERAL_QUERIES = 4096

# ----------------------------------------------------------------- chunking

BORDERS = ("\n\n", "\n", " ")  # preferred places to cut, best first


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, stop) offsets of chunks of at most ``size`` characters.

    A chunk ends at the last border of the best kind that lies in its window
    beyond the overlap (no border: at the window's end).  The next one starts at
    the first word that begins within the last ``overlap`` characters, else where
    the chunk ended.  White space at the ends is left out, blank spans too."""
    spans, start, n = [], 0, len(text)
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            cuts = (text.rfind(b, start + overlap + 1, stop) for b in BORDERS)
            stop = next((c for c in cuts if c >= 0), stop)
        body = text[start:stop]
        left = start + len(body) - len(body.lstrip())
        right = start + len(body.rstrip())
        if left < right:
            spans.append((left, right))
        if stop == n:
            break
        word = text.find(" ", max(stop - overlap, start + 1), stop)
        start = word + 1 if word >= 0 else stop
    return spans


def split_text(text: str | None, size: int = 7500, overlap: int = 100) -> list[str]:
    return [text[a:b] for a, b in split_spans(text or "", size, overlap)]


def text_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 7500,
                     overlap: int = 100) -> DataFrame:
    """(id, chunk_no, chunk): whole texts split by an Arrow-batched pandas
    UDF (per-document Python), exploded on the JVM."""
    @F.pandas_udf(ArrayType(StringType()))
    def split_udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    from orchard.sources.tables import spread
    return spread(df.select(id_col, text_col)).select(
        F.col(id_col), F.posexplode(split_udf(F.col(text_col))).alias("chunk_no", "chunk"))


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 7500,
                 overlap: int = 100) -> DataFrame:
    """(id, chunk_no, chunk_start, chunk): windows of ``size`` characters
    every ``size - overlap`` characters until the text is covered."""
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(step)))
    starts = F.sequence(F.lit(0), ((count - 1) * step).cast("int"), F.lit(step))
    from orchard.sources.tables import spread
    return (spread(df.select(id_col, text_col))
            .select(F.col(id_col), F.col(text_col), F.posexplode(starts).alias("chunk_no", "chunk_start"))
            .select(id_col, "chunk_no", "chunk_start",
                    F.substring(F.col(text_col), F.col("chunk_start") + 1, F.lit(size)).alias("chunk")))


# ---------------------------------------------------------------- embedding

def hashed_tfidf_embedder(corpus: DataFrame, text_col: str, dims: int = 256):
    """Fit a token -> hashed TF -> IDF -> L2-normalised embedder on
    ``corpus``; returns a function adding ``embedding array<float>``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[\p{L}\p{N}_]+", gaps=False, toLowercase=True),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_n", p=2.0),
    ])
    model = pipe.fit(corpus)

    def embed(df: DataFrame, col: str = text_col) -> DataFrame:
        src = df if col == text_col else df.withColumn(text_col, F.col(col))
        out = model.transform(src).withColumn("embedding", vector_to_array("_n", "float32"))
        return out.drop("_w", "_tf", "_idf", "_n")

    return embed


# ------------------------------------------------------------------- top-k

def l2(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def _as_double_array(c: Column) -> Column:
    return c.cast("array<double>")


def _distance_rows(qs: list[list[float]], k: int, cells: int = 1 << 22):
    """Batches (id, vector) -> (id, query number, distance), without the rows that k of their batch
    precede.  Sums run over the dimensions in order, as ``l2`` does.  A null vector, a null in it or
    another length than the query's gives a null distance; these rows are all kept."""
    size = np.array([len(q) for q in qs])

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.values
            first = lists.offsets.to_numpy()[:-1]
            whole = np.ones(b.num_rows, bool)
            if lists.null_count:
                whole &= lists.is_valid().to_numpy(zero_copy_only=False)
            if flat.null_count:
                bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                whole &= bad[first + n] == bad[first]
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            at, number, dist, valid = [], [], [], []
            for dims in np.unique(n[whole]).tolist():
                q = np.flatnonzero(size == dims)
                m = np.array([qs[i] for i in q], float).reshape(len(q), dims).T
                rows = np.flatnonzero(whole & (n == dims))
                step = max(1, cells // max(1, len(q)))
                for i in range(0, len(rows) if len(q) else 0, step):
                    some = rows[i:i + step]
                    total = np.zeros((len(some), len(q)))
                    with np.errstate(all="ignore"):
                        for j in range(dims):
                            diff = x[first[some] + j][:, None] - m[j]
                            total += diff * diff
                        d = np.sqrt(total)
                        keep = ~(d > np.partition(d, k - 1, axis=0)[k - 1]) if len(some) > k else np.ones(d.shape, bool)
                    r, c = np.nonzero(keep)
                    at.append(some[r]), number.append(q[c]), dist.append(d[r, c]), valid.append(np.ones(len(r), bool))
            r, c = np.nonzero(~whole[:, None] | (n[:, None] != size))
            at.append(r), number.append(c), dist.append(np.zeros(len(r))), valid.append(np.zeros(len(r), bool))
            at, number, dist, valid = (np.concatenate(v) for v in (at, number, dist, valid))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)),
                                              pa.array(dist, mask=~valid)], [b.schema.names[0], "_qi", "distance"])
    return run


def vector_topk(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame,
                qkey: Sequence[str], qvec_col: str, k: int,
                max_literal: int = MAX_LITERAL_QUERIES) -> DataFrame:
    """Exact k nearest vectors (Euclidean) for every query:
    (qkey..., rank, id, distance).  Ties by distance break on id."""
    v = vectors.select(F.col(id_col), _as_double_array(F.col(vec_col)).alias("_v"))
    # one job both sizes and fetches the query set: at most max_literal + 1 rows
    rows = queries.select(*qkey, _as_double_array(F.col(qvec_col)).alias("_q")).limit(max_literal + 1).collect()
    n = len(rows)
    if n <= max_literal:
        qs = [[float(x) for x in r["_q"]] for r in rows]
        keys = vectors.sparkSession.createDataFrame(
            [tuple([i] + [r[c] for c in qkey]) for i, r in enumerate(rows)],
            queries.select(F.lit(0).alias("_qi"), *qkey).schema) if rows else None
        dists = v.mapInArrow(_distance_rows(qs, k),
                             f"`{id_col}` {v.schema[id_col].dataType.simpleString()}, _qi int, distance double")
    else:
        blocks = math.ceil(n / max_literal)
        q = queries.select(*qkey, _as_double_array(F.col(qvec_col)).alias("_q"),
                           F.monotonically_increasing_id().alias("_qi")) \
            .withColumn("_g", F.pmod(F.xxhash64("_qi"), F.lit(blocks)))
        vv = v.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        pairs = vv.join(q, "_g")
        keys = q.select("_qi", *qkey)
        dists = pairs.select(F.col(id_col), "_qi", l2(F.col("_v"), F.col("_q")).alias("distance"))
    w = Window.partitionBy("_qi").orderBy(F.asc("distance"), F.asc(id_col))
    top = dists.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)
    if keys is None:
        return top.limit(0)
    return top.join(F.broadcast(keys) if n <= max_literal else keys, "_qi").select(
        *qkey, "rank", id_col, F.round("distance", 6).alias("distance"))


def multiquery_union(hits: DataFrame, question: str, id_col: str) -> DataFrame:
    """Union of the hits of all variants of a question without repeats:
    one row per (question, id) with the best distance and the number of
    variants that found it."""
    return hits.groupBy(question, id_col).agg(F.min("distance").alias("best_distance"),
                                              F.count(F.lit(1)).alias("n_variants"))


def lsh_topk(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qkey: str,
             qvec_col: str, k: int, bucket_length: float = 0.5, tables: int = 8,
             seed: int = 11) -> DataFrame:
    """Approximate k nearest by random-projection LSH: candidates share a
    bucket in some hash table (a shuffle join on bucket ids, no all-pairs
    product), ranked exactly among themselves."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(F.col(id_col), array_to_vector(F.col(vec_col)).alias("_vec"))
    q = queries.select(F.col(qkey), array_to_vector(F.col(qvec_col)).alias("_vec"))
    model = BucketedRandomProjectionLSH(inputCol="_vec", outputCol="_h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(v)
    pairs = model.approxSimilarityJoin(v, q, float("inf"), distCol="distance").select(
        F.col(f"datasetA.{id_col}").alias(id_col), F.col(f"datasetB.{qkey}").alias(qkey), "distance")
    w = Window.partitionBy(qkey).orderBy(F.asc("distance"), F.asc(id_col))
    return (pairs.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)
            .select(qkey, "rank", id_col, F.round("distance", 6).alias("distance")))


def centroids(vectors: DataFrame, keys: Sequence[str], vec_col: str, out: str = "centroid") -> DataFrame:
    """Mean vector per key: per-dimension averages (partial aggregation),
    reassembled in dimension order (one entry per dimension)."""
    long = vectors.select(*keys, F.posexplode(vec_col).alias("_d", "_x"))
    per_dim = long.groupBy(*keys, "_d").agg(F.avg("_x").alias("_m"))
    return per_dim.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias(out))


def assemble_context(hits: DataFrame, question: str, order: Sequence[Column], text_col: str,
                     sep: str = "\n\n") -> DataFrame:
    """Context text per question: the hit texts in rank order (the hits are
    top-k per question, so each group holds at most k rows)."""
    ordered = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                                                   F.col(text_col).alias("_t"))))
    return hits.groupBy(question).agg(F.concat_ws(sep, F.transform(ordered, lambda s: s["_t"])).alias("context"))
