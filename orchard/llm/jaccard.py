"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document's set holds its distinct ``k``-word shingles (64-bit hashes of the
A-Z-lower-cased words; fewer words: the whole sequence as one).  Two documents
link when ``den * |intersection| >= num * |union|``, that is when the sets
differ in at most H = (den - num)(r + s) // (den + num) elements.

Candidates.  Set sizes fall into bands (each 1.5 times the one before).  A band
cuts the hash universe into m > H segments.  H differing elements spoil at most
H segments, so linked sets agree on at least m - H of them; a segment that also
carries its one-deletion neighbourhood (its hash sum less one element, for every
element) takes two differences to spoil and counts two points.  A band's
allocation is the cheaper of the two kinds by ``cost``: neighbourhoods for short
sets, where they are few and each accidental match of a small segment would
cost a check, plain segments for long ones, where a neighbourhood would index
every element.  Sets near a band's upper border are also cut the lower band's
way, so every linked pair shares a cutting.

Allocation per document.  Keys held by one set only are dropped.  A set whose
shared keys sum to fewer than t = points - H points has no partner.  The larger
set of a pair probes; it may leave out its commonest keys as long as they sum to
at most t - 1 points less than it must find, since a partner shares t points.

Verification.  First round: every bucket's members against its best connected set
(a star, linear in the bucket), counted exactly on the whole hash sets, gives
components.  Second round, complete: in every bucket whose members are still in
different components, each prober meets the members of other components - all
pairs of a bucket of at most ``small`` sets, and in larger ones block by block
inside a task, which emits only pairs whose parity sketches differ in no more
bits than linked sets may differ in elements.  A pair of different texts is
either checked or already connected.  Nothing is capped.

Copies.  Equal sets (128-bit digest and size) are collapsed before the join and
expanded only as rows.  A different set is named by 64 bits of its digest.

Defined cases: null, empty or wordless documents have an empty set, link with
nothing and are their own component; rows with a null doc_id take no part and
get a null component; a repeated id's rows follow their own texts; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import U, blocks, discard, mix, release, semi_join, spread, stored, text_buffers, word_hashes
from orchard.llm.components import components

ELEMENTS = 1 << 22  # set elements of a block, at most; keys and sketches are a fraction of them
GROW = 1.5  # ratio of neighbouring bands
# cost of checking a pair, in index keys; chance that an element of a short set is shared by
# accident; elements of a typical shared passage, beyond which the chance falls with the size
CHECK, SHARED, PASSAGE = 40.0, 0.5, 30.0


@dataclass(frozen=True)
class Rule:
    """k words a shingle; similar when den * intersection >= num * union."""
    k: int = 4
    num: int = 85
    den: int = 100

    def distance(self, r: int, s: int) -> int:
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """Largest partner of a set of n."""
        return n * self.den // self.num


@lru_cache(maxsize=None)
def band_of(n: int) -> int:
    low, b = 1, 0
    while n >= (up := int(GROW * low) + 1):
        low, b = up, b + 1
    return b


@lru_cache(maxsize=None)
def band_range(b: int) -> tuple[int, int]:
    low = 1
    for _ in range(b):
        low = int(GROW * low) + 1
    return low, int(GROW * low)


@lru_cache(maxsize=None)
def allocation(rule: Rule, b: int) -> tuple[int, int, bool]:
    """(segments, points, with neighbourhoods) of band ``b``; (0, 0, False) where only equal sets link.

    Both kinds leave a fifth of the points above H + 1 for the documents to skip.
    Cost of a kind: keys a set of the band emits, plus the accidental matches of its
    segments, each as dear as ``CHECK`` keys; a segment of e elements is taken to
    match by accident with chance p ** e, p = min(SHARED, PASSAGE / size)."""
    low, high = band_range(b)
    top = rule.largest(high)
    h = rule.distance(high, top)
    if h == 0:
        return 0, 0, False
    need = h + 1 + -(-h // 5)
    plain, near = need, -(-need // 2)
    size = (low + high) / 2
    p = min(SHARED, PASSAGE / size)
    cost_plain = plain + CHECK * plain * p ** (size / plain)
    cost_near = near + size + CHECK * near * p ** max(0.0, size / near - 1)
    return (near, 2 * near, True) if cost_near < cost_plain else (plain, plain, False)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the block's documents in text order, and their offsets."""
    h, doc, _, _ = word_hashes(data, off)
    n = len(off) - 1
    size = np.bincount(doc, minlength=n)
    at = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h), U)
        for i in range(k):  # h[p], h[p + 1], ... ; positions near a document's end are dropped below
            acc[:len(h) - i] += mix(h[i:] + U(i + 1)) * U(2 * i + 3)
        acc = mix(acc)
    left = at[doc + 1] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    whole = left >= k
    short = np.flatnonzero((size > 0) & (size < k))
    for d in short:  # the whole sequence is one shingle
        with np.errstate(over="ignore"):
            seq = h[at[d]:at[d + 1]]
            acc[at[d]] = mix(np.sum(mix(seq + np.arange(1, len(seq) + 1).astype(U)) * U(2 * len(seq) + 31), keepdims=True))[0]
        whole[at[d]] = True
    out = acc[whole]
    return out, np.concatenate([[0], np.cumsum(np.bincount(doc[whole], minlength=n))])


def keys_of(s: np.ndarray, b: int, rule: Rule) -> np.ndarray:
    """Index keys of the set ``s`` cut the way of band ``b``.  The two low bits: band
    parity, and one if the key counts two points."""
    m, _, near = allocation(rule, b)
    if not m:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        seg = ((mix(s ^ U(0x5E65E65E65E6)) >> U(33)) % U(m)).astype(np.int64)
        v = mix(s + U(b * 7919 + 1))
        order = np.argsort(seg, kind="stable")
        seg, v = seg[order], v[order]
        total = np.zeros(m, U)
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
        if len(seg):
            total[seg[at]] = np.add.reduceat(v, at)
        tag = lambda i, x: mix(x ^ (i.astype(U) * U(0x9E3779B97F4A7C15) + U(b)))
        out = tag(np.arange(m), total)
        if near:
            out = np.concatenate([out, tag(seg, total[seg] - v)])
    return (np.unique(out) & ~U(3)) | U((b & 1) | (2 if near else 0))


def sketch(s: np.ndarray, b: int) -> bytes:
    """Parity of the set's elements in about twice as many bits as the band's largest set has
    elements.  Two sketches differ in at most as many bits as the sets differ in elements."""
    bits = 64 * -(-2 * band_range(b)[1] // 64)
    with np.errstate(over="ignore"):
        at = (mix(s + U(0x0DD5CE7C4)) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def _set_id(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(np.sum(mix(s)).view(np.int64)), int(np.sum(mix(s ^ U(0xABCDEF0123456789))).view(np.int64))) if len(s) else (0, 0)


def _all_keys(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Index keys of the set ``s``: its own band's, and the lower band's where a partner may lie there."""
    band = band_of(len(s))
    own = keys_of(s, band, rule)
    low = rule.largest(band_range(band - 1)[1] if band else 0) >= len(s)
    return np.concatenate([own, keys_of(s, band - 1, rule)]) if low else own


def _row_keys(rule: Rule):
    """(row, key) of every index key of ``doc_id``'s set."""
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in blocks(off):
                sh, at = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], rule.k)
                keys = [_all_keys(s, rule) if len(s := np.unique(sh[at[x]:at[x + 1]])) else np.zeros(0, U) for x in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], [len(k) for k in keys])),
                                                  pa.array(np.concatenate(keys).view(np.int64))], ["row", "key"])
    return run


def _describe(rule: Rule, with_keys: bool = True):
    """Per document: set size, digest, index keys (if asked for), and the points a partner must
    share: ``t_any`` with any partner, ``t_own`` and ``t_low`` with one no larger, when cut the
    own band's and the lower band's way."""
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            rows, keys, sketches = [], [], []
            for i, j in blocks(off):
                sh, at = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], rule.k)
                for x in range(j - i):
                    s = np.unique(sh[at[x]:at[x + 1]])
                    n, band, t_any, t_own, t_low, ks, sk = len(s), 0, 0, 0, 0, [], [None, None]
                    if n:
                        band = band_of(n)
                        points = allocation(rule, band)[1]
                        t_any, t_own = points - rule.distance(n, rule.largest(n)), points - rule.distance(n, n)
                        if with_keys:
                            ks.append(_all_keys(s, rule))
                        sk[0] = sketch(s, band)
                        top = band_range(band - 1)[1] if band else 0
                        if rule.largest(top) >= n:
                            sk[1] = sketch(s, band - 1)
                            t_low = allocation(rule, band - 1)[1] - rule.distance(n, top)
                    rows.append((n, *_set_id(s), band, t_any, t_own, t_low))
                    sketches.append(sk)
                    keys.append(np.concatenate(ks).view(np.int64) if ks else np.zeros(0, np.int64))
            if not rows:
                continue
            offs = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)),
                 pa.ListArray.from_arrays(offs, pa.array(np.concatenate(keys))), *(pa.array(c, pa.binary()) for c in zip(*sketches, strict=True))],
                ["doc_id", "n", "id", "d2", "band", "t_any", "t_own", "t_low", "keys", "sk_own", "sk_low"])
    return run


DESCRIBED = "doc_id long, n long, id long, d2 long, band long, t_any long, t_own long, t_low long, keys array<long>, " \
    "sk_own binary, sk_low binary"


def _sets(k: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            ids, out = [], []
            for i, j in blocks(off):
                sh, at = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], k)
                for x in range(j - i):
                    s = np.unique(sh[at[x]:at[x + 1]])
                    name = _set_id(s)[0]
                    if len(s) and name not in seen:
                        seen.add(name)
                        ids.append(name)
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "s"])
    return run


def _set_table(ids: DataFrame, docs: DataFrame, sets_of: DataFrame, rule: Rule) -> DataFrame:
    """(id, s): the sorted hash set of every set id in ``ids(id)``, from the texts, stored."""
    wanted = sets_of.join(ids.distinct(), "id").select("doc_id")
    return stored(semi_join(docs, wanted, ["doc_id"]).mapInArrow(_sets(rule.k), "id long, s binary"), "jaccard-sets")


def _verify(rule: Rule):
    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = rule.den * both >= rule.num * (len(x) + len(y) - both) and both > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def _linked(pairs: DataFrame, docs: DataFrame, sets_of: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set ids that are similar, stored."""
    pairs = stored(pairs.distinct(), "jaccard-pairs")
    sets = _set_table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, sets_of, rule)
    both = (pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
            .join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b"))
    links = stored(both.mapInArrow(_verify(rule), "a long, b long"), "jaccard-links")
    discard(pairs, sets)
    return links


def _pairs(df: DataFrame, x: str, nx: str, y: str, ny: str, rule: Rule) -> DataFrame:
    fits = F.least(nx, ny) * rule.den >= F.greatest(nx, ny) * rule.num
    return df.where(fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _stars(members: DataFrame, rule: Rule) -> DataFrame:
    """First round: each bucket's members against its best connected one (the largest sum of
    key frequencies, so mostly the same set in all buckets of a group).  Pairs that meet in few
    buckets are left to the second round, which is complete."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "n", "id", "ts")).alias("lead")
    lead = members.groupBy("key").agg(best).select(
        "key", F.col("lead.id").alias("lid"), F.col("lead.n").alias("ln"), F.col("lead.ts").alias("lts"))
    met = members.join(lead, "key").where("id <> lid").withColumn("least", F.least("ts", "lts"))
    met = met.groupBy("id", "n", "lid", "ln").agg(F.sum("pts").alias("met"), F.min("least").alias("least"))
    return _pairs(met.where("2 * met >= least"), "id", "n", "lid", "ln", rule)


def _small_pairs(members: DataFrame, rule: Rule) -> DataFrame:
    """Every pair of small buckets whose larger set probes and whose components differ."""
    g = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id", "sel", "c"))).alias("g"))
    p = g.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(filter(slice(g, 1, i), y -> x.sel and x.c <> y.c), "
                                  "y -> struct(y as s, x as l))))")).alias("p"))
    p = p.select(F.col("p.s.id").alias("x"), F.col("p.s.n").alias("nx"), F.col("p.l.id").alias("y"), F.col("p.l.n").alias("ny"))
    return _pairs(p, "x", "nx", "y", "ny", rule)


def _block_pairs(members: DataFrame, sketches: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of larger buckets, block of probers by block of members.  Pairs of different
    components come out if their parity sketches differ in no more bits than linked sets
    may differ in elements, once for each bucket in which they meet."""
    full = members.join(sketches, ["id", "own"]).join(sizes, "key")
    h = F.xxhash64("id")
    side = lambda flag, mine, other: full.where(flag).select(
        "key", "id", "n", "c", "sk", F.lit(mine == "p").alias("prober"),
        F.pmod(h, F.col(f"{mine}blocks")).alias(f"{mine}b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}blocks") - 1)).alias(f"{other}b"))
    rows = side(F.col("sel"), "p", "m").unionByName(side(F.col("own"), "m", "p"))

    def run(table: pa.Table) -> pa.Table:
        pro = table["prober"].to_numpy()
        p, m = table.filter(pa.array(pro)), table.filter(pa.array(~pro))
        (pn, pi, pc), (mn, mi, mc) = ([t[c].to_numpy() for c in ("n", "id", "c")] for t in (p, m))
        psk, msk = (t["sk"].to_pylist() for t in (p, m))
        plen, mlen = (np.array([len(v) for v in sk], np.int64) for sk in (psk, msk))
        small, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # one cutting has one sketch length; a set of another cutting is no partner here
        for length in np.intersect1d(plen, mlen):
            at = np.flatnonzero(mlen == length)
            words = np.frombuffer(b"".join(msk[w] for w in at), U).reshape(len(at), -1)
            n, i, c = mn[at], mi[at], mc[at]
            for u in np.flatnonzero(plen == length):
                ok = (n < pn[u]) | ((n == pn[u]) & (i < pi[u]))
                near = np.flatnonzero(ok & (n * rule.den >= pn[u] * rule.num) & (c != pc[u]))
                if len(near):
                    apart = np.bitwise_count(words[near] ^ np.frombuffer(psk[u], U)).sum(axis=1, dtype=np.int64)
                    found = i[near[apart <= (rule.den - rule.num) * (pn[u] + n[near]) // (rule.den + rule.num)]]
                    small.append(np.minimum(found, pi[u]))
                    large.append(np.maximum(found, pi[u]))
        return pa.table({"a": pa.array(np.concatenate(small), pa.int64()), "b": pa.array(np.concatenate(large), pa.int64())})

    return rows.groupBy("key", "pb", "mb").applyInArrow(run, "a long, b long")


def _members(single: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id, n, own, sel, pts, ts, score): each different set in the buckets it shares;
    ``sel`` where it probes, ``own`` where it is cut its own band's way; ``keys(row, key)``."""
    # keys move once: the counting and the join read the same exchange.  A set holds a key once, so
    # two rows make it shared; asking for the rows also keeps both readers' columns equal
    flat = keys.where("row is not null and key is not null").repartition("key")
    # (a name of its own for the key leaves the exchange's columns as they are, so that it is read twice)
    shared = (flat.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("df"), F.min("row").alias("x"), F.max("row").alias("y"))
              .where("x < y").select("k", "df"))
    own = F.col("key").bitwiseAND(F.lit(1)) == F.col("band") % 2
    info = single.select("row", "id", "n", "band", "t_any", "t_own", "t_low")
    hit = flat.join(shared.hint("merge"), F.col("key") == F.col("k")).join(info, "row").select(
        "id", "n", "key", "df", own.alias("own"), (F.shiftright(F.col("key").bitwiseAND(F.lit(2)), 1) + 1).alias("pts"),
        F.when(own, F.col("t_any")).otherwise(F.col("t_low")).alias("t"),
        F.when(own, F.col("t_own")).otherwise(F.col("t_low")).alias("ts"))
    # windows over one set's own keys; commonest first, left out while their points stay below ts
    mine = Window.partitionBy("id", "own")
    run = F.sum("pts").over(mine.orderBy(F.desc("df"), "key").rowsBetween(Window.unboundedPreceding, 0))
    hit = (hit.withColumn("c", F.sum("pts").over(mine)).withColumn("sel", run >= F.col("ts"))
           .withColumn("score", F.sum("df").over(mine)).where("c >= t"))
    return stored(hit.select("key", "id", "n", "own", "sel", "pts", "ts", "score"), "jaccard-members")


def near_copies(docs: DataFrame, rule: Rule = Rule(), small: int = 8, block: int = 1024, unique: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``; component_id is
    the smallest doc_id reachable by links.

    ``unique`` states that every row has an id of its own, none null: index keys are then made
    from the texts in the job that shuffles them, and not written before."""
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # the row number only has to be the same on every later read, and the rows are stored
    desc = docs.mapInArrow(_describe(rule, not unique), DESCRIBED)
    desc = stored(desc.drop("keys").withColumn("row", F.col("doc_id")) if unique else
                  desc.withColumn("row", F.monotonically_increasing_id()), "jaccard-docs")
    full = desc.where("n > 0 and doc_id is not null")
    reps = stored(full.groupBy("n", "id", "d2").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id")), "jaccard-reps")
    names = reps.select("id", "doc_id")
    single = semi_join(full, reps.select("row"), ["row"])
    keys = (semi_join(docs, reps.select("doc_id"), ["doc_id"]).mapInArrow(_row_keys(rule), "row long, key long") if unique else
            single.select("row", F.explode("keys").alias("key")))
    members = _members(single, keys)
    links = _linked(_stars(members, rule), docs, names, rule)
    comp = stored(components(links), "jaccard-components")
    # buckets that still hold a prober and two components
    named = members.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id"))
    blocks_of = lambda n: F.greatest(F.ceil(F.count(n) / block), F.ceil(F.sum(n) / ELEMENTS))
    probing = F.when(F.col("sel"), F.col("n"))
    sizes = named.groupBy("key").agg(F.count("*").alias("members"), blocks_of(F.col("n")).alias("mblocks"), blocks_of(probing).alias("pblocks"),
                                     F.min("c").alias("x"), F.max("c").alias("y")).where("pblocks > 0 and x <> y")
    sizes = stored(sizes.select("key", "members", "pblocks", "mblocks"), "jaccard-open")
    still = stored(named.join(sizes.select("key", "members"), "key").select("key", "id", "n", "own", "sel", "c", "members"), "jaccard-still")
    discard(members)
    large = still.where(F.col("members") > small).drop("members")
    sketches = single.select("id", F.inline(F.array(F.struct(F.lit(True).alias("own"), F.col("sk_own").alias("sk")),
                                                    F.struct(F.lit(False).alias("own"), F.col("sk_low").alias("sk"))))).where("sk is not null")
    pairs = _small_pairs(still.where(F.col("members") <= small), rule).unionByName(
        _block_pairs(large, sketches, sizes.select("key", "pblocks", "mblocks"), rule))
    more = _linked(pairs, docs, names, rule)
    discard(still, sizes)
    if more.limit(1).count():
        comp = stored(components(links.unionByName(more)), "jaccard-components")
    named = reps.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id"))
    label = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.select("n", "id", "d2", "c").join(label, "c").drop("c")
    out = desc.select("doc_id", "n", "id", "d2").join(named, ["n", "id", "d2"], "left")
    release(docs.sparkSession)
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
