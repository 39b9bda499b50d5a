"""Connected components of an edge table by alternating star contraction.

Each round hangs every vertex's larger neighbours on the smallest vertex around
it (large star), then the smaller ones (small star); stars remain when nothing
changes.  Edges of a task are contracted to a spanning forest before anything
moves.  All steps are partial aggregates and joins, nothing is gathered; a hub
with very many edges is one key of a map-side combined minimum and of a join
that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import stored


def _forest(batches):
    """Edges of one batch replaced by (root, vertex) with the root the smallest of its tree."""
    for b in batches:
        x, y = b.column("a").to_numpy(), b.column("b").to_numpy()
        ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        u, v = at[:len(x)], at[len(x):]
        root = np.arange(len(ids))
        while True:  # pointer jumping on the smallest neighbour
            low = root.copy()
            np.minimum.at(low, root[u], root[v])
            np.minimum.at(low, root[v], root[u])
            low = low[low]
            new = low[root]
            if (new == root).all() and (root[u] == root[v]).all():
                break
            root = new
        keep = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[keep]]), pa.array(ids[keep])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of ``edges(a, b)``; component is the smallest id.

    Each round's edges are stored once in the shared folder.  ``max_rounds`` is
    a guard that raises; it never returns unfinished components."""
    cur = stored(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "cc")
    for _ in range(max_rounds):
        # every vertex keeps its smallest smaller neighbour; a second one is linked to that smallest
        low = cur.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("x"))
        if not low.where("m <> x").limit(1).count():
            lows = low.select(F.col("b").alias("v"), F.col("m"))
            up = cur.join(lows, cur["a"] == lows["v"], "left")
            if not up.where("v is not null").limit(1).count():
                break
        low = low.select("b", "m")
        linked = cur.join(low, "b").select(F.col("m"), "a", "b")
        # (m, a) joins the parents of a vertex, (m, b) hangs the vertex itself
        pairs = linked.select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        # shortcut: a parent that has a smaller parent itself
        tops = low.select(F.col("b").alias("p"), F.col("m").alias("g"))
        pairs = pairs.join(tops, pairs["a"] == tops["p"], "left").select(
            F.coalesce("g", "a").alias("a"), "b", F.col("a").alias("was"), "g")
        pairs = pairs.select(F.explode(F.when(F.col("g").isNull(), F.array(F.struct("a", "b"))).otherwise(
            F.array(F.struct("a", "b"), F.struct("a", F.col("was").alias("b"))))).alias("e")).select("e.a", "e.b")
        cur = stored(pairs.where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return cur.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)
