"""Periodic runs in word sequences by recompression.

``find_runs`` numbers the words of a block of documents exactly, lays the
documents out in one sequence with a separator of its own before and after each,
and compresses that sequence into a run-length grammar: block compression turns
every maximal repetition of one symbol into a symbol (symbol, count), pair
compression parts the symbols in two sides and turns every left symbol that a
right one follows into a symbol of the pair.  Both depend on the symbols alone,
so equal stretches are compressed alike except at their borders.  That makes the
longest common extension of two positions a walk up the levels while the
cursors stand on borders of equal symbols, and down again where they differ -
done for all candidates of a block together.

A run of period p and length >= 4p holds a multiple t of 3p with t and t + p both
inside, so the candidates are the pairs (t, t + p) of that harmonic grid whose
words agree, as do those beside them on the left or right.  The extensions to
both sides give the run's exact borders; of several periods with the same borders
the smallest is the run's.  No suffix array, no shuffle: documents are independent,
and a task holds one block of about 1 MB of text (a longer document alone).

Defined cases: a null or blank text has no words, no runs and an empty collapsed
text; repeated rows and null doc_ids are rows like others; extra columns are left
out; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import blocks, mix, text_buffers

LEAST, TIMES = 6, 4  # a run has max(LEAST, TIMES * period) words
SINGLE = 256  # periods below it are looked at one by one, larger ones many together
GRID = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level(NamedTuple):
    sym: np.ndarray  # symbols of this level
    first: np.ndarray | None  # index of each symbol's first child one level down, with the end
    parent: np.ndarray | None  # index, on this level, of the parent of each symbol one level down


def _named(pairs: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    code, seen = pd.factorize(pairs)
    return code.astype(np.int64) + base, base + len(seen)


def _level(sym: np.ndarray, first: np.ndarray, below: int) -> Level:
    first = np.append(first, below)
    return Level(sym, first, np.repeat(np.arange(len(sym)), np.diff(first)))


def grammar(words: np.ndarray, least: int = 64) -> tuple[list[Level], list[bool]]:
    """Levels of the run-length grammar of ``words`` (numbers from 0) until ``least`` symbols
    are left, and for each level whether block compression made it."""
    sym = words.astype(np.int64)
    names = int(sym.max()) + 1 if len(sym) else 0
    levels, block = [Level(sym, None, None)], [False]
    for turn in range(200):
        if len(sym) <= max(1, least):
            break
        head = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        if len(head) < len(sym):
            count, size = np.diff(np.append(head, len(sym))), len(sym)
            new = sym[head]
            many = count > 1
            new[many], names = _named(new[many] * (int(count.max()) + 1) + count[many], names)
            sym = new
            levels.append(_level(sym, head, size))
            block.append(True)
        side = (mix(sym.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
        left, right = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
        start = np.flatnonzero(left if left.sum() >= right.sum() else right)
        if len(start):
            stays = np.ones(len(sym), bool)
            stays[start + 1] = False
            new = sym.copy()
            new[start], names = _named(sym[start] * names + sym[start + 1], names)
            keep, size = np.flatnonzero(stays), len(sym)
            sym = new[keep]
            levels.append(_level(sym, keep, size))
            block.append(False)
    return levels, block


def extensions(levels: list[Level], block: list[bool], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from i and j on (``step`` 1) or back from them (-1), i < j.
    Both ends of the sequence must hold a word that occurs nowhere else."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    fell = np.zeros(len(a), np.int64)  # the level on which the cursors' symbols differ
    live, last = np.arange(len(a)), len(levels) - 1
    for k in range(last):
        sym, up = levels[k].sym, levels[k + 1]
        x, y = a[live], b[live]
        same = sym[x] == sym[y]
        fell[live[~same]] = k
        live, x, y = live[same], x[same], y[same]
        if not len(live):
            break
        px, py = up.parent[x], up.parent[y]
        if step > 0:
            on = (up.first[px] == x) & (up.first[py] == y)
            rx, ry = up.first[px + 1] - x, up.first[py + 1] - y
        else:
            on = (up.first[px + 1] - 1 == x) & (up.first[py + 1] - 1 == y)
            rx, ry = x - up.first[px] + 1, y - up.first[py] + 1
        move = np.where(on, 0, np.minimum(rx, ry)) * step  # to the nearer border
        x, y = x + move, y + move
        a[live], b[live] = x, y
        up_too = on | (rx == ry)
        fell[live[~up_too]] = k  # one block ends before the other
        live = live[up_too]
        a[live], b[live] = up.parent[x[up_too]], up.parent[y[up_too]]
    top = levels[last].sym
    while len(live):
        same = top[a[live]] == top[b[live]]
        fell[live[~same]] = last
        live = live[same]
        a[live] += step
        b[live] += step
    for k in range(last, 0, -1):
        at = np.flatnonzero(fell >= k)
        first, sym = levels[k].first, levels[k - 1].sym
        x, y = a[at], b[at]
        nx, ny = first[x + 1] - first[x], first[y + 1] - first[y]
        x, y = (first[x], first[y]) if step > 0 else (first[x + 1] - 1, first[y + 1] - 1)
        move = np.where(sym[x] == sym[y], np.minimum(nx, ny) if block[k] else 1, 0) * step
        a[at], b[at] = x + move, y + move
    return np.abs(a - i)


def _grid(length: np.ndarray, end: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, p): multiples of 3p, for each period as far as the texts of 4p words or more reach
    (``length`` descends, ``end`` is where each text ends in the sequence)."""
    reach = end[np.searchsorted(-length, -np.maximum(TIMES * periods, LEAST), "right") - 1]
    step = (TIMES - 1) * periods
    many = -(-reach // step)
    p = np.repeat(periods, many)
    nth = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    return nth * np.repeat(step, many), p


def runs_of(seq: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of ``seq``, texts in order of falling ``length``."""
    none = np.zeros(0, np.int64)
    longest = int(length[0]) // TIMES if len(length) and length[0] >= LEAST else 0
    found = []
    p = 1
    while p <= longest:
        q = p + 1
        if p >= SINGLE:  # as many periods together as make about GRID pairs
            q = min(longest + 1, p + max(1, GRID * 3 * p // max(1, len(seq))))
        t, per = _grid(length, end, np.arange(p, q))
        p = q
        fits = t + per + 1 < len(seq)
        t, per = t[fits], per[fits]
        same = np.flatnonzero(seq[t] == seq[t + per])
        t, per = t[same], per[same]
        beside = (seq[t + 1] == seq[t + 1 + per]) | ((t > 0) & (seq[t - 1] == seq[t - 1 + per]))
        found.append((t[beside], per[beside]))
    t = np.concatenate([f[0] for f in found]) if found else none
    if not len(t):
        return none, none, none
    per = np.concatenate([f[1] for f in found])
    levels, block = grammar(seq, 2 * len(length) + 64)
    ahead = extensions(levels, block, t, t + per, 1)
    back = extensions(levels, block, t - 1, t - 1 + per, -1)
    start, stop = t - back, t + per + ahead
    long = stop - start >= np.maximum(LEAST, TIMES * per)
    start, stop, per = start[long], stop[long], per[long]
    order = np.lexsort((per, stop, start))
    start, stop, per = start[order], stop[order], per[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[new], stop[new], per[new]


def _block_runs(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text the (start, length, period) rows of its runs, and its collapsed text."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = pa.array([w for k in order for w in words[k]], pa.binary())
    number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(length + 1) - length  # a separator before each text and after the last
    seq = np.empty(len(number) + len(texts) + 1, np.int64)
    own = np.ones(len(seq), bool)
    own[np.append(begin - 1, len(seq) - 1)] = False
    seq[own] = number
    seq[~own] = (int(number.max()) + 1 if len(number) else 0) + np.arange(len(texts) + 1)
    start, stop, per = runs_of(seq, length, begin + length)
    text = np.searchsorted(begin, start, "right") - 1
    rows = [np.zeros((0, 3), np.int64)] * len(texts)
    kept = [b" ".join(w) for w in words] if not len(start) else [None] * len(texts)
    if len(start):
        gone = np.zeros(len(seq) + 1, np.int64)
        np.add.at(gone, start + per, 1)
        np.add.at(gone, stop, -1)
        stays = np.cumsum(gone) == 0
        lo = np.searchsorted(text, np.arange(len(texts)), "left")
        hi = np.searchsorted(text, np.arange(len(texts)), "right")
        for r, k in enumerate(order):
            if hi[r] > lo[r]:
                s = slice(lo[r], hi[r])
                rows[k] = np.stack([start[s] - begin[r], stop[s] - start[s], per[s]], 1)
                kept[k] = b" ".join(compress(words[k], stays[begin[r]:begin[r] + length[r]].tolist()))
            else:
                kept[k] = b" ".join(words[k])
    return rows, kept


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed: the
    words that no run repeats, joined by one space, of every row of ``docs(doc_id, text)``."""

    def scan(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            raw = data.tobytes()
            for lo, hi in blocks(off):
                rows, kept = _block_runs([raw[off[k]:off[k + 1]] for k in range(lo, hi)])
                at = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
                three = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
                spans = pa.StructArray.from_arrays([pa.array(three[:, c]) for c in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), spans),
                     pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's runs and collapsed texts."""
    best = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) "
                  "when x.start <> y.start then if(x.start < y.start, -1, 1) else cast(sign(x.period - y.period) as int) end)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    out = found.withColumn("_best", F.get(best, F.lit(0)))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The contract's text: for a tenth of the ids the words repeat from some place on
    (rows with a null id are left as they are)."""
    id_, body = f"cast({doc_id} as string)", f"cast({text} as string)"
    return F.expr(f"""
        case when {doc_id} is null or crc32(cast({id_} as binary)) % 10 <> 0 then {body}
        else transform(array(named_struct('w', filter(split({body}, '[\\\\x20\\\\x09-\\\\x0D]+'), v -> v <> ''),
                                          'g', crc32(cast({id_} as binary)) div 10)), x ->
             if(size(x.w) < 1, {body}, transform(array(named_struct('w', x.w, 'n', size(x.w), 'a', cast(x.g % size(x.w) as int),
                    'p', cast(1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8) as int))), y ->
                 concat_ws(' ', transform(sequence(0, y.n - 1), i -> y.w[if(i < y.a, i, y.a + (i - y.a) % y.p)])))[0]))[0] end""")
