"""Row scorers for text: any Python scorer over Arrow batches, with an error column.

A scorer is a callable ``text -> list of floats`` (one score per class).  It raises
``RuntimeError`` for a text it cannot score; that row gets the message in ``error`` and no
scores, and the job goes on.  Any other exception is a defect and stops the job.
``score_text`` takes a function that loads the scorer, called once per task.

The default scorer is a multinomial naive Bayes.  Spark counts its words per class as
integers; words share ``buckets`` rows by md5, so the model has a size known beforehand
(``buckets`` x classes longs, 1.5 MB by default) and is broadcast.  Log-likelihoods are
kept in millionths as integers: a text's sum does not depend on the order of its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orchard.sources.tables import spread

BUCKETS = 1 << 16
UNIT = 1_000_000
WORD = regex.compile(r"\p{L}+")
_REMEMBERED = 1 << 18  # words whose bucket a scorer remembers


class Unscorable(RuntimeError):
    """A text the scorer cannot take; the message goes to the error column."""


def word_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets


def fixed_log(p: np.ndarray) -> np.ndarray:
    """ln in millionths, as integers."""
    return np.floor(np.log(p) * UNIT + 0.5).astype(np.int64)


class NaiveBayes:
    """log prior + sum of the words' log-likelihoods, one score per class."""

    def __init__(self, prior: np.ndarray, weights: np.ndarray):
        self.prior, self.weights = prior, weights
        self._bucket: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        b = self._bucket.get(word)
        if b is None:
            if len(self._bucket) >= _REMEMBERED:
                self._bucket.clear()
            b = self._bucket[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % len(self.weights)
        return b

    def __call__(self, text: str | None) -> list[float]:
        words = WORD.findall(text.lower()) if text else []
        if not words:
            raise Unscorable("no words to score")
        rows = np.fromiter(map(self.bucket, words), np.int64, len(words))
        return [int(s) / UNIT for s in self.prior + self.weights[rows].sum(axis=0)]


class Limited:
    """A scorer that takes at most ``max_words`` words, as pretrained networks with a fixed
    window do; longer texts are errors, never cut."""

    def __init__(self, scorer: Callable, max_words: int):
        self.scorer, self.max_words = scorer, max_words

    def __call__(self, text: str | None) -> list[float]:
        if text and len(WORD.findall(text)) > self.max_words:
            raise Unscorable(f"more than {self.max_words} words")
        return self.scorer(text)


def fit_naive_bayes(docs: DataFrame, text_col: str, label_col: str, classes: int,
                    buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(prior, weights) with one added count per bucket and class.

    Words are counted per class before they are put into buckets, so the shuffle carries one
    row per different word and class of a partition, however hot a word is.  ``buckets`` rows at
    most reach the driver.  Rows with a NULL label teach nothing; NULL texts count in the prior."""
    rows = spread(docs.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("c"))
                  .where(F.col("c").between(0, classes - 1)))
    n_docs = np.zeros(classes, np.int64)
    for r in rows.groupBy("c").count().collect():
        n_docs[r["c"]] = r["count"]
    words = (rows.select("c", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)).alias("w"))
             .groupBy("w", "c").agg(F.count(F.lit(1)).alias("n")))
    table = (words.groupBy(word_bucket(F.col("w"), buckets).alias("b"))
             .agg(*[F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(classes)])
             .toArrow())
    counts = np.zeros((buckets, classes), np.int64)
    at = table["b"].to_numpy()
    for c in range(classes):
        counts[at, c] = table[f"n{c}"].to_numpy()
    prior = fixed_log((n_docs + 1) / (n_docs.sum() + classes))
    return prior, fixed_log((counts + 1) / (counts.sum(axis=0) + buckets))


def naive_bayes_loader(docs: DataFrame, text_col: str, label_col: str, classes: int,
                       buckets: int = BUCKETS, max_words: int | None = None) -> Callable[[], Callable]:
    """Fits the default scorer and returns the function that loads it in a task."""
    model = docs.sparkSession.sparkContext.broadcast(fit_naive_bayes(docs, text_col, label_col, classes, buckets))

    def load():
        scorer = NaiveBayes(*model.value)
        return scorer if max_words is None else Limited(scorer, max_words)
    return load


def score_text(df: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable], classes: int) -> DataFrame:
    """(id, scores array<double>, error string): one row per row of ``df``, either scores or an
    error.  NULL and blank texts go to the scorer like any other (the default one refuses them);
    NULL ids and repeated rows are rows each; other columns are not read."""
    def one(scorer, text) -> tuple[Sequence[float] | None, str | None]:
        try:
            scores = [float(s) for s in scorer(text)]
        except RuntimeError as e:
            return None, str(e) or type(e).__name__
        if len(scores) != classes or not all(map(math.isfinite, scores)):
            return None, f"scorer gave no {classes} finite scores"
        return scores, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for b in batches:
            done = [one(scorer, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in done], pa.list_(pa.float64())),
                 pa.array([e for _, e in done], pa.string())], names=[id_col, "scores", "error"])

    work = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")))
    id_type = work.schema[0].dataType.simpleString()
    return work.mapInArrow(run, f"`{id_col}` {id_type}, scores array<double>, error string")
