"""Licence scan in DataFrame functions alone: sparse TF-IDF cosine of every line to
licence notices, then inheritance from the nearest directory above that
declares a licence, by joins on paths.

Terms are ``TERM`` matches of the lower-cased line.  idf(term) = ln((1 + T) /
(1 + df)) + 1 over the T templates (df 0 for any other term), weight = count *
idf, and the line's norm runs over all of its terms.  The best line's cosine,
rounded to six places, decides; ``threshold`` or more is a notice, ties go to
the smaller name.

Only lines that can reach the threshold are tokenised: for each template the
heaviest terms are taken as cues until what is left weighs less than
``threshold`` of its norm.  By Cauchy-Schwarz a line without any cue of a
template stays below the threshold for it, so the filter loses nothing.

A directory declares the commonest licence of its declaring files (ties: the
smaller name).  A file's licence is its own notice, else that of the nearest
directory on its path that declares one.  Ancestors are taken per distinct
directory, and files meet them by a join on the directory: one row per directory
on that side, so a directory with a third of all files is split by adaptive
execution.

Defined cases: null or empty texts have no notice and can inherit; a null path
has no directory, but its own notice; repeated rows are reported each; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orchard.functions import json_literal
from orchard.llm.common import stored

# fixed values: short notices by SPDX identifier
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by the BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential.",
}
STOP = "the of to is by this and in all a".split()  # never cues while others suffice
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6


def weights() -> tuple[dict[str, float], dict[str, dict[str, float]], float]:
    """(idf by term, unit weights by template and term, idf of any other term)."""
    counts = {name: {} for name in TEMPLATES}
    for name, text in TEMPLATES.items():
        for t in re.findall(TERM, text.lower()):
            counts[name][t] = counts[name].get(t, 0) + 1
    terms = sorted({t for c in counts.values() for t in c})
    n = len(TEMPLATES)
    idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts.values()))) + 1 for t in terms}
    unit = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        unit[name] = {t: k * idf[t] / norm for t, k in c.items()}
    return idf, unit, math.log(1 + n) + 1


def cues(threshold: float = THRESHOLD) -> list[str]:
    _, unit, _ = weights()
    out: set[str] = set()
    for w in unit.values():
        rest = sorted(w, key=lambda t: (t in STOP, -w[t], t))
        while rest and sum(w[t] ** 2 for t in rest) >= (threshold - 1e-6) ** 2:
            out.add(rest.pop(0))
    return sorted(out)


def cue_pattern(threshold: float = THRESHOLD) -> str:
    return r"\b(?:" + "|".join(re.escape(c).replace(r"\-", "-") for c in cues(threshold)) + r")\b"


def _best(terms: Column) -> Column:
    """(neg, license) of the best template for the sorted ``terms`` of a line, in one fold: the k-th
    copy of a term adds (2k - 1) idf^2 to the squared norm, as k^2 grows by 2k - 1."""
    idf, unit, other = weights()
    known = json_literal({t: {"idf": v, "w": [unit[n].get(t, 0.0) * v for n in TEMPLATES]} for t, v in idf.items()},
                         "map<string,struct<idf:double,w:array<double>>>")
    start = F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("norm"),
                     F.array_repeat(F.lit(0.0), len(TEMPLATES)).alias("dots"))

    def step(acc, t):
        hit = F.try_element_at(known, t)
        run = F.when(acc["term"] == t, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("term"), run.alias("run"),
                        (acc["norm"] + (2 * run - 1) * F.pow(F.coalesce(hit["idf"], F.lit(other)), F.lit(2.0))).alias("norm"),
                        F.when(hit.isNull(), acc["dots"]).otherwise(F.zip_with(acc["dots"], hit["w"], lambda x, y: x + y)).alias("dots"))

    def best(acc):
        return F.array_min(F.array(*[F.struct((-F.round(acc["dots"][i] / F.sqrt(acc["norm"]), 6)).alias("neg"), F.lit(n).alias("license"))
                                     for i, n in enumerate(TEMPLATES)]))
    return F.aggregate(terms, start, step, best)


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, h, license, score, line, n_lines) of the best line of each text that holds a notice;
    h is the hash of the text.  Lines are scored in their rows; only notices are shuffled."""
    text = F.lower(F.col("text"))
    lines = (files.where(text.rlike(cue_pattern(threshold)))
             .select("path", "h", F.split(text, "\n").alias("all"))
             .select("path", "h", F.size("all").alias("n_lines"), F.posexplode("all").alias("line", "s"))
             .where(F.col("s").rlike(cue_pattern(threshold))))
    terms = F.array_sort(F.regexp_extract_all("s", F.lit(TERM), F.lit(0)))
    # exploded from an array of one, so that the filter below does not score a line a second time
    best = (lines.select("path", "h", "line", "n_lines", F.explode(F.array(_best(terms))).alias("b"))
            .where(F.col("b.neg") <= -threshold))
    first = best.groupBy("path", "h").agg(F.min(F.struct("b.neg", "b.license", "line", "n_lines")).alias("m"))
    return first.select("path", "h", F.col("m.license").alias("license"), (-F.col("m.neg")).alias("score"), "m.line", "m.n_lines")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, declares: Column, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, path, license, score, via ('notice', 'directory', 'none') and from_dir of
    each row of ``files(path, text)``.

    ``declares`` says on (path, line, n_lines, license) whether a file with a notice speaks for its directory."""
    # names of our own, so that no column of ``keep`` can clash
    rows = files.select(F.struct(*keep).alias("kept"), "path", "text").withColumn("h", F.xxhash64("text"))
    found = stored(notices(rows.select("path", "h", "text"), threshold), "notices")  # read twice below
    speaking = (found.where(declares).select(directory(F.col("path")).alias("dir"), "license").where("dir is not null")
                .groupBy("dir", "license").agg(F.count("*").alias("n"))
                .groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("neg"), "license")).alias("m"))
                .select(F.col("dir").alias("above"), F.col("m.license").alias("inherited")))
    listed = rows.select("kept", "path", "h", directory(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    chain = listed.select("dir").where("dir is not null").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = (chain.join(speaking, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("m"))
               .select("dir", F.col("m.above").alias("from_dir"), F.col("m.inherited").alias("inherited")))
    own_notice = found.select(F.col("path").alias("_path"), F.col("h").alias("_h"), "license", "score")
    out = listed.join(own_notice, F.col("path").eqNullSafe(F.col("_path")) & (F.col("h") == F.col("_h")), "left").join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select("kept.*", "path", F.coalesce("license", "inherited").alias("license"), "score",
                      F.when(own, "notice").when(F.col("inherited").isNotNull(), "directory").otherwise("none").alias("via"),
                      F.when(~own, F.col("from_dir")).alias("from_dir"))


def named_like_licence() -> Column:
    """The usual rule for ``declares``: files named LICENSE, LICENCE, COPYING or NOTICE."""
    return F.lower("path").rlike(r"(^|/)(licen[cs]e|copying|notice)[^/]*$")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents carry no path: source / thousands / hundreds / id stand for a tree."""
    n = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(n / 1000).cast("string"),
                       F.floor(n / 100).cast("string"), n.cast("string"))
    return docs.select("doc_id", F.when(n.isNotNull(), path).alias("path"), F.col("text").cast("string").alias("text"))


def document_licences(docs: DataFrame) -> DataFrame:
    """A document that opens or ends with its notice stands for a licence file of its directory."""
    return scan(document_paths(docs), (F.col("line") == 0) | (F.col("line") == F.col("n_lines") - 1), ["doc_id"])


def oracle() -> str:
    idf, unit, other = weights()
    rows = ", ".join(f"('{n}', '{t}', {w!r}::DOUBLE)" for n, ws in unit.items() for t, w in ws.items())
    idfs = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items())
    return f"""
WITH w(license, term, w) AS (VALUES {rows}), idf(term, idf) AS (VALUES {idfs}),
f AS (SELECT doc_id, coalesce(source, 'none') || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CAST(doc_id // 100 AS VARCHAR)
             || '/' || CAST(doc_id AS VARCHAR) AS path, lower(text) AS t FROM documents),
l AS (SELECT doc_id, len(p) AS n_lines, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS s FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM f)),
ends AS (SELECT DISTINCT doc_id, n_lines FROM l),
terms AS (SELECT doc_id, line, unnest(regexp_extract_all(s, '{TERM}')) AS term FROM l WHERE regexp_matches(s, '[a-z0-9]')),
tf AS (SELECT doc_id, line, term, count(*) AS tf FROM terms GROUP BY ALL),
norm AS (SELECT doc_id, line, sqrt(sum(pow(tf * coalesce(idf, {other!r}::DOUBLE), 2))) AS norm
         FROM tf LEFT JOIN idf USING (term) GROUP BY ALL),
dot AS (SELECT doc_id, line, license, sum(tf * idf * w) AS dot FROM tf JOIN idf USING (term) JOIN w USING (term) GROUP BY ALL),
best AS (SELECT doc_id, license, line, score FROM (
  SELECT doc_id, license, line, round(dot / norm, 6) AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 6) DESC, license, line) AS r
  FROM dot JOIN norm USING (doc_id, line)) WHERE r = 1 AND score >= {THRESHOLD}),
say AS (SELECT dir, license FROM (
  SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, license) AS r
  FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license FROM best JOIN f USING (doc_id) JOIN ends USING (doc_id)
        WHERE line = 1 OR line = n_lines)
  GROUP BY dir, license) WHERE r = 1),
up AS (SELECT doc_id, k, array_to_string(list_slice(p, 1, k), '/') AS dir
       FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS k FROM (SELECT doc_id, string_split(path, '/') AS p FROM f))),
near AS (SELECT doc_id, max_by(dir, k) AS from_dir, max_by(license, k) AS inherited FROM up JOIN say USING (dir) GROUP BY doc_id)
SELECT f.doc_id, f.path, coalesce(b.license, inherited) AS license, score,
       CASE WHEN b.license IS NOT NULL THEN 'notice' WHEN inherited IS NOT NULL THEN 'directory' ELSE 'none' END AS via,
       CASE WHEN b.license IS NULL THEN from_dir END AS from_dir
FROM f LEFT JOIN best b USING (doc_id) LEFT JOIN near USING (doc_id)
"""
