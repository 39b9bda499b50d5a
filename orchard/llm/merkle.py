"""Merkle manifest of a dataset: one tree per group of rows, one over the groups.

Rows become leaves, numbered by a range partitioning of (group, order) whose sorted
partitions are stored with their row numbers; partition counts give the offsets, so no
task numbers a whole group.  Every level is an equijoin of the stored nodes with
themselves: a node computes the index of its run's slot-zero sibling (its own index
XOR 1 for arity 2, its slot as offset otherwise), slot-zero rows take their siblings in
and emit the parent.  Groups of all sizes climb together and leave when one node remains.
The way down joins each stored run with the path of its parent, so a path is built once
per run, not once per leaf; a group's root begins with its path in the tree of groups,
so that a group with a third of all rows is no hot key anywhere.

A path is an array of (left, right): the joined digests of the siblings on both sides,
from the leaf up to the root, with which ``folded`` recomputes the root of any leaf.

Defined cases: nulls in any column are part of the leaf (as ``-``); a null group comes
first; rows with the same id are ordered by leaf, identical rows are leaves each;
a lone row is its group's root; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import crc_mod, written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:`, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    return digest_of(*[encoded(changed.get(f, F.col(f))) for f in fields])


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (grp, ...) stored with pos (0 .. within its grp, by ``order``) and size (rows of grp)."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "_tie"]  # the tie spreads identical rows over ranges
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-rows")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    # one row per group and range
    counts = rows.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("size"))
    return (rows.join(counts, ["grp", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_first", "_before"))


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """Siblings joined to their slot-zero row: (grp, pos and size of the parent, kids)."""
    slot = F.col("pos") % arity
    nodes = nodes.where("size > 1")
    runs = nodes.where(slot == 0).select("grp", "pos", "size", F.col("kid").alias("k0"))
    for d in range(1, arity):
        zero = F.col("pos").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("pos") - slot
        runs = runs.join(nodes.where(slot == d).select("grp", zero.alias("pos"), F.col("kid").alias(f"k{d}")), ["grp", "pos"], "left")
    kids = F.filter(F.array(*[f"k{d}" for d in range(arity)]), lambda k: k.isNotNull())
    return runs.select("grp", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), kids.alias("kids"))


def _joined(hashes: Column) -> Column:
    return F.concat_ws("", hashes)


def proofs(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], arity: int = ARITY) -> DataFrame:
    """``nodes``: (grp, pos, size, kid: struct with the digest h).  ``above`` turns the groups'
    roots (grp, height, h) into (grp, height, path, top).  Returns (kid, path, top) of every node."""
    nodes = nodes.select("grp", "pos", "size", "kid")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels, at = [], nodes
    roots = nodes.where("size = 1").select("grp", F.lit(0).alias("height"), F.col("kid.h").alias("h"))
    while arity ** len(levels) < largest:
        levels.append(written(_runs(at, arity), "merkle-level"))
        at = levels[-1].select("grp", "pos", "size", F.struct(digest_of(_joined(F.col("kids.h"))).alias("h")).alias("kid"))
        roots = roots.unionByName(at.where("size = 1").select("grp", F.lit(len(levels)).alias("height"), F.col("kid.h").alias("h")))
    tops = written(above(roots), "merkle-roots")
    begin = lambda height: tops.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("pos"), "path", "top")
    lone = nodes.where("size = 1").select("grp", "kid").join(begin(0).drop("pos"), "grp")
    if not levels:
        return lone.select("kid", "path", "top")
    paths, leaves = None, None
    for height in range(len(levels), 0, -1):
        paths = begin(height) if paths is None else paths.unionByName(begin(height))
        run = levels[height - 1].select("grp", "pos", "kids").join(paths, ["grp", "pos"])
        kid = run.select("grp", "pos", "kids", "path", "top", F.posexplode("kids").alias("slot", "kid"))
        left = _joined(F.slice("kids.h", F.lit(1), F.col("slot")))
        right = _joined(F.slice("kids.h", F.col("slot") + 2, F.lit(arity)))
        leaves = kid.select("grp", (F.col("pos") * arity + F.col("slot")).alias("pos"), "kid", "top",
                            F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path").alias("path"))
        paths = leaves.drop("kid")
    return leaves.select("kid", "path", "top").unionByName(lone.select("kid", "path", "top"))


def manifest(leaves: DataFrame, order: Sequence[str], arity: int = ARITY) -> DataFrame:
    """Trees over ``leaves`` (grp string or null, h, any other columns): all columns of ``leaves``
    but grp as struct ``kid``, ``path`` to the root over all groups, ``subroot`` and ``root``."""
    # `=` before the group's name keeps the order of bytes and tells a null from every name
    key = F.when(F.col("grp").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("grp")))
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    keyed = leaves.select(key.alias("grp"), F.struct(*[c for c in leaves.columns if c != "grp"]).alias("kid"), *by)

    def one_root(roots: DataFrame) -> DataFrame:
        empty = F.expr("cast(array() as array<struct<left:string,right:string>>)")
        return roots.select("grp", "height", empty.alias("path"), F.struct(F.lit("").alias("subroot"), F.col("h").alias("root")).alias("top"))

    def over_groups(roots: DataFrame) -> DataFrame:
        each = roots.select(F.lit("").alias("grp"), F.struct("h", "grp", "height").alias("kid"), F.col("grp").alias("name"))
        found = proofs(numbered(each, ["name"]), one_root, arity)
        return found.select("kid.grp", "kid.height", "path", F.struct(F.col("kid.h").alias("subroot"), F.col("top.root").alias("root")).alias("top"))

    found = proofs(numbered(keyed, [f"_by{i}" for i in range(len(order))]), over_groups, arity)
    return found.select("kid", "path", "top.subroot", "top.root")


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(h: Column, path: Column) -> Column:
    """The root that leaf ``h`` gives with the siblings of ``path``."""
    return F.aggregate(path, h, lambda up, s: digest_of(s["left"], up, s["right"]))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Every row of ``documents`` with its leaf, roots and proof, and what becomes of the root
    when the text of half of the ids loses its line ends (a null id counts as an empty text
    in choosing that half)."""
    # translate() with a shorter replacement deletes
    tampered = F.when(crc_mod("doc_id", 2) == 0, leaf(text=F.translate(F.col("text").cast("string"), "\n", "")))
    leaves = docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
                         leaf().alias("h"), tampered.alias("tampered"))
    found = manifest(leaves, ["doc_id", "h"])
    out = found.select("kid.*", "path", "subroot", "root").withColumn(
        "folded_root", folded(F.coalesce("tampered", "h"), F.col("path")))
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# the SQL twin: crc32 by its bytewise table (0xEDB88320, reflected), trees by recursion over levels
ORACLE = r"""
with recursive crc_table as (
    select list(list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as crc
    from range(256) as b(n)),
rows_in as (
    select *, list_reduce(list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint),
                          lambda c, b: xor(c >> 8, crc[1 + xor(c & 255, b)]), 4294967295) as c
    from documents, crc_table),
enc as (
    select doc_id, source,
           coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
           text, replace(text, chr(10), '') as cut, doc_id is null or xor(c, 4294967295) % 2 = 0 as hit from rows_in),
leaves as (
    select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || case when hit then coalesce(strlen(cut) || ':' || cut, '-') else coalesce(strlen(text) || ':' || text, '-') end) as other
    from enc),
placed as (
    select *, dense_rank() over (order by source nulls first) as grp,
           row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by source) as size from leaves),
tree(grp, lvl, pos, size, h) as (
    select grp, 0, pos, size, leaf from placed
    union all
    select grp, lvl + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' order by pos))
    from tree where size > 1 group by grp, lvl, pos // 3, size),
tops(grp, lvl, pos, size, h) as (
    select 0, 0, grp - 1, (select max(grp) from placed), h from tree where size = 1
    union all
    select grp, lvl + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' order by pos))
    from tops where size > 1 group by grp, lvl, pos // 3, size),
nodes as (select * from tree union all select * from tops),
beside as (
    select n.grp, n.lvl, n.pos, coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos < n.pos), '') as l,
           coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos > n.pos), '') as r
    from nodes n join nodes s on s.grp = n.grp and s.lvl = n.lvl and s.pos // 3 = n.pos // 3
    where n.size > 1 group by n.grp, n.lvl, n.pos),
walk(leaf_grp, leaf_pos, grp, lvl, pos, step, up, l, r) as (
    select grp, pos, grp, 0, pos, 0, other, '', '' from placed
    union all
    select w.leaf_grp, w.leaf_pos,
           case when b.grp is null then 0 else w.grp end, case when b.grp is null then 0 else w.lvl + 1 end,
           case when b.grp is null then w.leaf_grp - 1 else w.pos // 3 end, w.step + 1,
           case when b.grp is null then w.up else sha256(b.l || w.up || b.r) end, coalesce(b.l, ''), coalesce(b.r, '')
    from walk w left join beside b on b.grp = w.grp and b.lvl = w.lvl and b.pos = w.pos
    where b.grp is not null or w.grp > 0),
proof as (
    select leaf_grp, leaf_pos, sha256(string_agg(l || r, '' order by step)) as proof_sha256, max_by(up, step) as folded_root
    from walk group by leaf_grp, leaf_pos)
select p.doc_id, p.leaf, s.h as subroot, t.h as root, f.proof_sha256, f.folded_root, f.folded_root = t.h as verified
from placed p join proof f on f.leaf_grp = p.grp and f.leaf_pos = p.pos
join tree s on s.grp = p.grp and s.size = 1 join tops t on t.size = 1
"""
