"""Hierarchical language identification: family first, then one-versus-one
linear support vector machines among the languages of that family.

Features are counts of byte 1- to 4-grams of the lower-cased text (everything
but letters and marks beyond ASCII becomes one space), hashed into ``BUCKETS``,
square-rooted and scaled to unit length.  Every classifier is a linear machine
with squared hinge loss, trained in numpy by accelerated gradient steps; its
margin becomes a probability by a one-parameter logistic fit.

Families come from ``FAMILIES``; a learned language outside that table is a family
of its own.  The score is P(family) * P(language within the family), each the
product of the winner's pairwise probabilities against its rivals.

Fit.  The score compares learned languages only.  Whether a text is of any of them is
told by its similarity (cosine) to the nearest language's mean features: it must reach
the least one usual for texts of its length, calibrated on whole texts and excerpts of
the learnable rows that had no part in the means.  ``fit`` is the similarity less that
least one, whatever the number of languages.

Training sample: of the learnable rows, at most ``per_language`` rows of each
language with the smallest hash of their id, a documented bound that keeps the
driver's matrix small.  Rows with a null doc_id teach nothing.  Whole texts are read; prediction runs over all
rows and all of every text.

Defined cases: null text or text without a letter gives ``und`` with score 0;
with one learned language that one has score 1; with none every row is ``und``.
Null or empty lang rows teach nothing.  Repeated rows are predicted each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import crc_mod, spread

# fixed values: ISO 639-1 codes by family
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ca ro gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
OVERDRAW = 4  # candidates a language for each wanted training row
SIGMAS, LEAST_SIZE = 4.5, 3.0  # below 8 bytes any text with a letter fits
LETTER = regex.compile(r"\p{L}")  # digits and number signs like ½ are no letters
KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), lang)


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split()) + b" "


def _excerpt(text: str, seed: int) -> str:
    """Consecutive words of a text, their number uniform on a log scale; fixed by ``seed``."""
    rng, words = np.random.default_rng(seed), text.split()
    n = int(np.exp(rng.uniform(0, np.log(len(words) + 1))))
    at = rng.integers(0, len(words) - n + 1)
    return " ".join(words[at:at + n])


def features(texts: list[str | None], block: int = 1 << 20) -> np.ndarray:
    """documents x BUCKETS, unit rows (zero rows for texts without letters)."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        b = _normal(t)
        counts = np.zeros(BUCKETS, np.int64)
        for s in range(0, len(b), block):  # blocks overlap by the longest n-gram less one
            x = np.frombuffer(b[s:s + block + max(ORDERS) - 1], np.uint8).astype(np.uint32)
            h = np.zeros(len(x), np.uint32)
            for k in ORDERS:
                n = len(x) - k + 1
                if n <= 0:
                    break
                h = h[:n] * np.uint32(0x01000193) ^ x[k - 1:k - 1 + n] + np.uint32(k)
                start = min(n, block)  # starts of this block only
                counts += np.bincount((h[:start] * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
        row = np.sqrt(counts)
        out[i] = row / max(np.linalg.norm(row), 1e-9)
    return out


class LinearMachine:
    """sign(x w + b); probability of the positive class 1 / (1 + exp(-a (x w + b)))."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120):
        pos = max(1, int((y > 0).sum()))
        weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * max(1, len(y) - pos))).astype(np.float32)
        w = np.zeros(x.shape[1] + 1, np.float32)  # the last entry belongs to a constant column, which is not built
        v, step = w.copy(), 1.0 / (1.0 + 4 * c)  # rows have norm sqrt(2) at most: the curvature is bounded
        for t in range(rounds):
            slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
            push = weight * y * slack
            grad = v - 2 * c / len(x) * np.append(x.T @ push, push.sum()) / max(1.0, weight.max() / 1.0)
            new = v - step * grad
            v, w = new + t / (t + 3) * (new - w), new
        self.w, self.b = w[:-1], float(w[-1])
        m = y * (x @ self.w + w[-1])
        grid = np.geomspace(0.5, 200, 60)
        self.a = float(grid[np.argmin([np.mean(np.logaddexp(0, -a * m)) for a in grid])])

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * (x @ self.w + self.b), -60, 60)))


class LanguageModel:
    def __init__(self, x: np.ndarray, lang: list[str], short: np.ndarray | None = None, sizes: np.ndarray | None = None):
        """``short``: features of an excerpt of each row; ``sizes``: normal bytes of (text, excerpt)."""
        self.means = self._means(x, lang)
        self.size_of, self.least = np.zeros(1), np.zeros(1)
        if short is not None and len(x):
            self._calibrate(x, np.array(lang), short, sizes)
        self.langs = sorted(set(lang))
        y = np.array(lang)
        fam = np.array([family_of(v) for v in lang])
        self.families = {f: sorted(set(y[fam == f])) for f in sorted(set(fam))}
        self.family_machines = self._pairs(x, fam, sorted(self.families))
        self.within = {f: self._pairs(x[fam == f], y[fam == f], members) for f, members in self.families.items()}

    @staticmethod
    def _means(x, lang) -> np.ndarray:
        """Unit mean features by language."""
        lang = np.array(lang)
        means = np.array([x[lang == v].mean(0) for v in sorted(set(lang))]).reshape(-1, BUCKETS)
        return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)

    def _calibrate(self, x, lang, short, sizes):
        """Least usual similarity by length: the median less ``SIGMAS`` deviations of the lower side."""
        half = np.arange(len(x)) % 2 == 1
        if not half.any():
            return
        near, length = [], []
        for own in (half, ~half):  # against the means of the other half
            means = self._means(x[~own], lang[~own])
            near += [(v[own].astype(np.float32) @ means.T).max(1) for v in (x, short)]
            length += [np.log2(np.maximum(sizes[own, k], 1)) for k in (0, 1)]
        near, length = np.concatenate(near), np.concatenate(length)
        at, least = [LEAST_SIZE], [0.0]
        for k in np.unique(np.floor(length)):
            some = near[np.floor(length) == k]
            if len(some) >= 30 and k + 0.5 > LEAST_SIZE:
                middle, lower = np.median(some), np.quantile(some, 0.05)
                at.append(k + 0.5)
                least.append(max(0.0, middle - SIGMAS * max((middle - lower) / 1.645, 0.01)))
        if len(at) > 1:  # other lengths lie between or take the nearest
            self.size_of, self.least = np.array(at), np.array(least)

    def fits(self, texts: list[str | None], x: np.ndarray) -> np.ndarray:
        """Similarity to the nearest language less the least usual one; -1 without languages."""
        if not len(self.means):
            return np.full(len(texts), -1.0)
        size = np.log2([max(1, len(_normal(t))) if t else 1 for t in texts])
        return (x @ self.means.T).max(1) - np.interp(size, self.size_of, self.least)

    @staticmethod
    def _pairs(x, y, classes):
        out = {}
        for a, b in itertools.combinations(classes, 2):
            rows = (y == a) | (y == b)
            out[a, b] = LinearMachine(x[rows], np.where(y[rows] == a, 1.0, -1.0).astype(np.float32))
        return out

    @staticmethod
    def _vote(x, machines, classes) -> tuple[np.ndarray, np.ndarray]:
        """Winner (index) by won duels, then by probability; and its probability."""
        votes, logs = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        for (a, b), m in machines.items():
            p, i, j = m.prob(x), classes.index(a), classes.index(b)
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
            logs[:, i] += np.log(np.maximum(p, 1e-12))
            logs[:, j] += np.log(np.maximum(1 - p, 1e-12))
        best = np.argmax(votes + logs / (1e4 * max(1, len(classes))), axis=1)
        return best, np.exp(logs[np.arange(len(x)), best])

    def predict(self, texts: list[str | None], block: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, fit) of each text."""
        langs, scores, fits = [], [], []
        for s in range(0, len(texts), block):
            part = texts[s:s + block]
            x = features(part)
            names, score = np.array(["und"] * len(part), object), np.zeros(len(part))
            if self.langs:
                fams = sorted(self.families)
                f, pf = self._vote(x, self.family_machines, fams)
                for k, fam in enumerate(fams):
                    at = np.flatnonzero(f == k)
                    if len(at):
                        w, pw = self._vote(x[at], self.within[fam], self.families[fam])
                        names[at] = [self.families[fam][i] for i in w]
                        score[at] = pf[at] * pw
            blank = np.array([not t or not LETTER.search(t) for t in part], bool)
            names[blank], score[blank] = "und", 0.0
            langs += names.tolist()
            scores.append(score)
            fits.append(np.where(blank, -1.0, self.fits(part, x)))
        return (langs, *(np.concatenate(v) if v else np.zeros(0) for v in (scores, fits)))


def train(docs: DataFrame, learnable: Column, per_language: int = 800) -> LanguageModel:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)`` where ``learnable`` holds."""
    named = docs.where(learnable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.trim("lang") != ""))
    rows = named.where(F.col("text").isNotNull())
    # one row a language, of which the driver holds per_language feature rows anyway
    sizes = named.groupBy("lang").agg(F.greatest(F.approx_count_distinct("doc_id"), F.lit(1)).alias("n")).toArrow()
    share = docs.sparkSession.createDataFrame(
        [(x, min(1.0, OVERDRAW * per_language / n)) for x, n in zip(sizes["lang"].to_pylist(), sizes["n"].to_pylist(), strict=True)],
        "lang string, share double")
    # ids only: the sample is drawn without moving texts, and of a large language only the ids
    # with the smallest hashes, about OVERDRAW times as many as wanted, are put in order
    low = (F.xxhash64("doc_id").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (rows.select("doc_id", "lang").join(F.broadcast(share), "lang").where(low <= F.col("share"))
              .distinct().withColumn("r", F.row_number().over(order))
              .where(F.col("r") <= per_language).select("doc_id").distinct())
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id", "left_semi")
    # one text of repeated rows, so that the sample keeps its bound
    sample = sample.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for b in batches:
            keep = [i for i, t in enumerate(b.column("text").to_pylist()) if LETTER.search(t)]
            b = b.take(pa.array(keep, pa.int64()))
            ids, texts = b.column("doc_id").cast(pa.string()), b.column("text").to_pylist()
            short = [_excerpt(t, zlib.crc32(i.encode())) for t, i in zip(texts, ids.to_pylist(), strict=True)]
            x, y = (pa.array([r.tobytes() for r in features(v).astype(np.float16)], pa.binary()) for v in (texts, short))
            sizes = [[len(_normal(t)), len(_normal(s))] for t, s in zip(texts, short, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, b.column("lang"), x, y, pa.array(sizes, pa.list_(pa.int64()))],
                                             ["doc_id", "lang", "x", "short", "sizes"])

    got = sample.mapInArrow(run, "doc_id string, lang string, x binary, short binary, sizes array<long>").toArrow()
    order = np.argsort(np.array(got["doc_id"].to_pylist(), object), kind="stable")
    lang, sizes = np.array(got["lang"].to_pylist(), object)[order].tolist(), np.array(got["sizes"].to_pylist()).reshape(-1, 2)[order]
    x, short = _rows(got["x"], order).astype(np.float32), _rows(got["short"], order)
    del got
    pa.default_memory_pool().release_unused()
    return LanguageModel(x, lang, short, sizes)


def _rows(col: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Feature rows, read from the column's own buffers, in the given order."""
    parts = [np.frombuffer(c.buffers()[2], np.float16).reshape(-1, BUCKETS)[c.offset:c.offset + len(c)] for c in col.chunks if len(c)]
    return np.concatenate([np.zeros((0, BUCKETS), np.float16), *parts])[order]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and fit (columns of those names are replaced)."""
    docs = docs.drop("lang_pred", "score", "fit")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, fit = sent.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())],
                                             [*b.schema.names, "lang_pred", "score", "fit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return spread(docs).mapInArrow(run, f"{schema}, lang_pred string, score double, fit double")


def held_out(mod: int = 4, value: int = 2) -> Column:
    return crc_mod("doc_id", mod) == value


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = train(docs, ~held_out())
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
