"""Vector collections with a cell index and exact top-k from it.

``build_index`` learns centres by k-means from a sample of about ``SAMPLE_ROWS`` rows and stores
*every* vector with its cell and its distance to the cell's centre (its radius), sorted by both, so
the reader skips row groups of other cells.  A table of cells (at most ``MAX_CELLS`` rows: centre,
rows, least and greatest radius) goes with them.

``search_index`` is exact.  By the triangle inequality a vector of radius r in a cell whose centre
lies d from the query is at least |d - r| away.  A query first probes its nearest cells that hold k
rows; their k-th distance bounds the answer.  Each further round takes ``WIDEN`` times as many cells
and compares only the rows in the ring |d - r| <= bound, until no cell with a ring is left: then
the k-th distance is proven.  On vectors without clusters (random directions in many
dimensions) the rings hold all rows and every vector is compared once per query, as in a scan.

Probes meet the rows on the cell.  Few probes are broadcast (their size is counted); more of them
are joined on (cell, slice), a cell's rows being dealt to slices of about ``SLICE_ROWS``, so a
cell with a third of all rows, or of all copies of one vector, is many keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from orchard.functions import json_literal
from orchard.operators.retrieval import l2
from orchard.session import scratch_path

SAMPLE_ROWS = 65_536    # rows that teach the centres; all rows are indexed
MAX_CELLS = 1024
SLICE_ROWS = 65_536
WIDEN = 8
PROBE_BYTES = 32 << 20  # probes up to this size are broadcast
MAX_COMPONENT = 1e150   # squares of larger components overflow
SLACK = 1e-9            # rounding allowance of the bounds, relative to the distances

_CELLS = "array<struct<cell:int,n:long,lo:double,hi:double,centre:array<double>>>"


def usable(vec: Column) -> Column:
    """Vectors that have a distance: not NULL, not empty, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def _too_far(vec: Column) -> Column:
    return F.exists(vec, lambda x: F.abs(x) > MAX_COMPONENT)


def build_index(vectors: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None,
                keep: Sequence[str] = (), seed: int = 11) -> None:
    """Writes ``path/rows`` (id, vec, cell, radius, deal, *keep) and ``path/cells``.

    NULL, empty and non-finite vectors are not in the index; NULL ids and repeated rows are rows
    each; all vectors must have one length and no component beyond ``MAX_COMPONENT`` (else ValueError).  Only ``keep`` columns are stored
    along, under names other than the index's own (else ValueError).  An empty table gives an empty index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    clash = {"id", "vec", "cell", "radius", "deal"} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the index: {sorted(clash)}")
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                       *keep).where(usable(F.col("vec")))
    n, least, most, far = v.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec")),
                                F.count_if(_too_far(F.col("vec")))).first()
    if far:
        raise ValueError(f"{far} vectors with components beyond {MAX_COMPONENT}")
    if n and least != most:
        raise ValueError(f"vectors of {least} to {most} components in one collection")
    centres = spark.createDataFrame([], "cell int, centre array<double>")
    placed = v.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("radius"))
    if n:
        sample = v if n <= SAMPLE_ROWS else v.where(F.rand(seed) < SAMPLE_ROWS / n)
        # different vectors only: the centres start from k of them
        sample = sample.select("vec").distinct().select(array_to_vector("vec").alias("_f")).checkpoint()
        k = min(MAX_CELLS, cells or math.isqrt(n), sample.count())
        if k > 1:
            model = KMeans(k=k, seed=seed, maxIter=10, initMode="random", featuresCol="_f", predictionCol="cell").fit(sample)
            found = model.clusterCenters()
            assigned = model.transform(v.withColumn("_f", array_to_vector("vec"))).drop("_f")
        else:  # one cell
            found, assigned = [sample.first()["_f"]], placed.drop("radius")
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")
        # MAX_CELLS centres at most
        placed = assigned.join(F.broadcast(centres), "cell").withColumn("radius", l2(F.col("vec"), F.col("centre")))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    (placed.select("id", "vec", "cell", "radius", deal.alias("deal"), *keep)
     .repartitionByRange("cell", "radius", "deal").sortWithinPartitions("cell", "radius")
     .write.mode("overwrite").parquet(f"{path}/rows"))
    stored = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("r_min"), F.max("radius").alias("r_max"))
    centres.join(stored, "cell").write.mode("overwrite").parquet(f"{path}/cells")


def _probes(queries: DataFrame, cells: list, k: int) -> DataFrame:
    """(_q, no, start, least, d, cell): the cells of each query, numbered by the least distance a row
    of theirs can have; the first ``start`` are those of the first round, with k rows at least."""
    table = json_literal([{"cell": c["cell"], "n": c["n"], "lo": c["r_min"], "hi": c["r_max"], "centre": list(c["centre"])}
                          for c in cells], _CELLS)

    def probe(c):
        d = l2(F.col("_qv"), c["centre"])
        return F.struct(F.greatest(F.lit(0.0), d - c["hi"], c["lo"] - d).alias("least"), d.alias("d"),
                        c["cell"].alias("cell"), c["n"].alias("n"))

    def take(acc, p):
        full = acc["rows"] >= k
        return F.struct((acc["rows"] + F.when(full, 0).otherwise(p["n"])).alias("rows"),
                        (acc["cells"] + F.when(full, 0).otherwise(1)).alias("cells"))
    start = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).alias("cells")), take)["cells"]
    return (queries.select("_q", F.array_sort(F.transform(table, probe)).alias("p"))
            .select("_q", start.alias("start"), F.posexplode("p").alias("no", "c"))
            .select("_q", "no", "start", "c.least", "c.d", "c.cell"))


def search_index(spark: SparkSession, path: str, queries: DataFrame, qkey: Sequence[str], qvec_col: str, k: int,
                 stats: dict | None = None, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """The exact k nearest rows of each query: (*qkey, rank, id, distance), equal distances by id.

    Fewer than k rows come only if the index holds fewer.  A NULL, empty or non-finite query vector
    has no rows; one of another length than the collection's, or beyond
    ``MAX_COMPONENT``, is a ValueError; repeated queries are queries each.  ``stats`` receives the number of rounds and of distances computed."""
    stats = {} if stats is None else stats
    stats.update(rounds=0, distances=0)
    work = scratch_path(spark, "index-search")
    # written once: the numbers stay the same for all rounds
    (queries.select(*qkey, F.col(qvec_col).cast("array<double>").alias("_qv")).where(usable(F.col("_qv")))
     .withColumn("_q", F.monotonically_increasing_id()).write.parquet(f"{work}/queries"))
    q = spark.read.parquet(f"{work}/queries")
    rows = spark.read.parquet(f"{path}/rows")
    cells = spark.read.parquet(f"{path}/cells").collect()  # MAX_CELLS rows at most
    best = q.limit(0).join(rows.limit(0)).select("_q", "id", F.lit(0.0).alias("distance"))
    if cells:
        dims = len(cells[0]["centre"])
        if not q.where((F.size("_qv") != dims) | _too_far(F.col("_qv"))).isEmpty():
            raise ValueError(f"the collection takes vectors of {dims} components, none beyond {MAX_COMPONENT}")
        _probes(q, cells, k).write.parquet(f"{work}/probes")
        probes = spark.read.parquet(f"{work}/probes")
        slices = spark.createDataFrame([(c["cell"], max(1, -(-c["n"] // SLICE_ROWS))) for c in cells], "cell int, slices int")
        done, upto = F.lit(0), F.col("start")
        while True:
            kth = best.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
            bound = F.coalesce("bound", F.lit(float("inf")))
            rest = (probes.where(F.col("no") >= done).join(kth, "_q", "left").withColumn("bound", bound)
                    .where(F.col("least") <= F.col("bound") + SLACK * (F.col("bound") + F.col("d"))))
            size = rest.agg(F.count(F.when(F.col("no") < upto, 1)).alias("now"), F.count(F.lit(1)).alias("all"),
                            F.collect_set(F.when(F.col("no") < upto, F.col("cell"))).alias("cells")).first()
            if not size["all"]:
                break
            if size["now"]:
                stats["rounds"] += 1
                asks = rest.where(F.col("no") < upto).select("_q", "cell", "d", "bound").join(q.select("_q", "_qv"), "_q")
                best = _compare(rows.where(F.col("cell").isin(size["cells"])), asks, best, k, slices, stats,
                                size["now"] * (8 * dims + 64) <= probe_bytes, f"{work}/best-{stats['rounds']}")
            done, upto = upto, upto * WIDEN
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "id"))
    return best.withColumn("rank", rank).join(q.drop("_qv"), "_q").select(
        *qkey, "rank", "id", F.round("distance", 6).alias("distance"))


def _compare(rows, asks, best, k: int, slices, stats: dict, small: bool, path: str) -> DataFrame:
    """The k best of ``best`` and of the asked rows, written: k rows a query at most."""
    if small:
        pairs = rows.join(F.broadcast(asks), "cell")
    else:
        asks = asks.join(F.broadcast(slices), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        dealt = rows.join(F.broadcast(slices), "cell").withColumn("slice", F.col("deal") % F.col("slices"))
        pairs = dealt.drop("slices").join(asks.drop("slices"), ["cell", "slice"])
    reach = F.col("bound") + SLACK * (F.col("bound") + F.col("d") + F.col("radius"))
    seen = Observation()
    near = (pairs.where(F.abs(F.col("d") - F.col("radius")) <= reach)
            .select("_q", "id", l2(F.col("vec"), F.col("_qv")).alias("distance")).observe(seen, F.count(F.lit(1)).alias("n")))
    order = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "id"))
    near.unionByName(best).withColumn("rank", order).where(F.col("rank") <= k).drop("rank").write.parquet(path)
    stats["distances"] += seen.get["n"]
    return near.sparkSession.read.parquet(path)
