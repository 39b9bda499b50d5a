"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of the benchmark items; every document is scanned once, whole.

Normalisation lower-cases A-Z and keeps words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
(ASCII letters and digits, and everything beyond ASCII).  Words are joined by
one space with a space at both ends, as UTF-8 bytes, so the pattern
`` w1 ... wk `` occurs exactly where those words stand in sequence.  A window
is ``window`` consecutive words of an item; a shorter item with words is one
window.

Defined cases: a null or wordless document has no words and no hits; a null or
wordless item has no windows; repeated items share windows and are all
reported; repeated document rows give one row each; a null item_id takes part
in hits but is not listed; extra columns are ignored; empty tables give no rows
or no hits.

The automaton is broadcast: ``max_bytes`` bounds the benchmark text one
automaton may hold.  A larger benchmark is cut into automata of that size that
scan one after another (each with the whole corpus), and hits are merged.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import spread

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def item_windows(items: list[tuple], window: int) -> dict[bytes, set]:
    """pattern -> ids of the items that hold it."""
    out: dict[bytes, set] = {}
    for item_id, text in items:
        w = normal_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(b" " + b" ".join(w[i:i + window]) + b" ", set()).add(item_id)
    return out


def build_automaton(patterns: dict[bytes, set]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p.decode("latin-1"), (len(p), p.count(b" ") - 1, tuple(ids)))
    if len(a):
        a.make_automaton()
    return a


def scan_text(text: str | None, automata: list) -> tuple[int, list[tuple[int, int]], set]:
    """(words, hit word ranges [first, end) merged, item ids) of one text."""
    words = normal_words(text)
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found, ids = [], set()
    for a in automata:
        if len(a):
            for end, (size, k, items) in a.iter(norm):
                found.append((end - size + 1, k))
                ids.update(items)
    if not found:
        return len(words), [], ids
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])  # offset of the space before each word
    first = np.searchsorted(starts, [s for s, _ in found])
    merged: list[list[int]] = []
    for s, e in sorted((int(f), int(f) + k) for f, (_, k) in zip(first, found, strict=True)):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return len(words), [(s, e) for s, e in merged], ids


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) character offsets of the original text."""
    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


HITS = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>"


def scan_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` (a column text among them) with n_words, n_hit, items (sorted ids
    as strings) and hit_spans, character ranges of the original text; columns of those
    names are replaced."""
    spark = docs.sparkSession
    groups, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        size += len(r[1] or "")
        if size > max_bytes and groups[-1]:
            groups.append([])
            size = len(r[1] or "")
        groups[-1].append((r[0], r[1]))
    patterns = [spark.sparkContext.broadcast(item_windows(g, window)) for g in groups]
    docs = docs.drop("n_words", "n_hit", "items", "hit_spans")
    cache: list = []

    def scan(batches):
        if not cache:
            cache.extend(build_automaton(p.value) for p in patterns)
        for b in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for t in b.column("text").to_pylist():
                n, ranges, ids = scan_text(t, cache)
                n_words.append(n)
                n_hit.append(sum(e - s for s, e in ranges))
                items.append(sorted(i for i in ids if i is not None))
                spans.append([{"start": s, "end": e} for s, e in char_spans(t, ranges)] if ranges else [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*b.schema.names, "n_words", "n_hit", "items", "hit_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return spread(docs).mapInArrow(scan, f"{schema}, {HITS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, items, hit_spans."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return scan_rows(docs, benchmark, window).drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    joined = F.concat_ws(",", F.col("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_FOLDED = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLDED.format(c="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS k FROM pat),
win AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM win JOIN pat USING (p)),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
