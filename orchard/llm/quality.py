"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer numpy network with temperature-calibrated probabilities.

Units.  Every white-space word gives two units: the word (letters and digits,
case folded, hashed into ``WORDS`` rows) and its shape (case pattern, amount of
punctuation, digits, repetition of the word before, no letters at all).

Word vectors.  Each unit has a fixed sparse ternary index vector (``NNZ`` entries
of +1 or -1 among ``DIMS``, from its hash).  Over the whole corpus, a unit's vector
is the sum of the index vectors around it: the own shape and the words and
shapes to its left and right.  Tasks add into one small matrix each (its size
does not depend on the data); the matrices are summed by row chunk, streaming,
and never gathered.

Pooling and network.  A document is the mean of its words' unit-length vectors,
the mean of its shapes' vectors, and its log word count.  The network (tanh
layer, logistic output) is trained with Adam on standardised inputs; on a
fifth of the sample, held back, the temperature that minimises the log loss
divides the logit.

Training sample: at most ``max_rows`` labelled rows with the smallest hash of the
id (a documented bound); everything else covers all rows and whole texts.
Labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts pool to zero vectors and are scored like
any other row; without usable labels every score is 0.5, with labels of one
class only its share; several labels of one id count by their largest; repeated
rows are scored each; extra columns stay out of the way; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import SPACE, U, _powers, blocks, crc_mod, mix, spans, spread, text_buffers

SHAPES, WORDS, DIMS, NNZ = 96, 1 << 14, 32, 2
ROWS = SHAPES + WORDS
CHUNKS = 16

_h = mix(np.arange(ROWS * NNZ, dtype=np.uint64) + U(17)).reshape(ROWS, NNZ)
INDEX_AT = (_h % U(DIMS)).astype(np.int64)
INDEX_SIGN = np.where((_h >> U(40)) & U(1), 1.0, -1.0)


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, shape row, document) per word of a block."""
    start, _, doc = spans(data, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z
    after_c3 = np.zeros(len(data), bool)  # second byte of a Latin letter of two bytes
    after_c3[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (after_c3 & (data >= 0xA0) & (data <= 0xBE))
    digit = (data >= 48) & (data <= 57)
    word = upper | lower | digit | (data >= 0x80)
    punct = ~word & ~SPACE[data]
    count = lambda m: np.add.reduceat(m.astype(np.int32), start)
    up, low, dig, pun = count(upper), count(lower), count(digit), count(punct)
    p, inv = _powers(len(data))
    with np.errstate(over="ignore"):
        v = (data + (upper.view(np.uint8) << 5)).astype(U) * p
        v[~word] = 0
        h = mix(np.add.reduceat(v, start) * inv[start])
    none = count(word) == 0
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    again = np.zeros(len(doc), bool)
    again[1:] = (h[1:] == h[:-1]) & ~first[1:] & ~none[1:]
    case = np.where(up == 0, 0, np.where((up >= 2) & (low == 0), 2, np.where(up == 1, 1, 3)))
    shape = (((case * 3 + np.minimum(pun, 2)) * 2 + (dig > 0)) * 2 + again) * 2 + none
    return SHAPES + (h % U(WORDS)).astype(np.int64), shape, doc


def _accumulate(batches):
    """One matrix of context sums a task, as rows (chunk, matrix part)."""
    m = np.zeros(ROWS * DIMS)
    for batch in batches:
        data, off = text_buffers(batch.column("text"))
        for i, j in blocks(off):
            word, shape, doc = units(data[off[i]:off[j]], off[i:j + 1] - off[i])
            if not len(word):
                continue
            same = np.flatnonzero(doc[1:] == doc[:-1])
            around = [(np.arange(len(word)), shape), (same + 1, word[:-1][same]), (same + 1, shape[:-1][same]),
                      (same, word[1:][same]), (same, shape[1:][same])]
            at, ctx = (np.concatenate(x) for x in zip(*around, strict=True))
            for centre in (word, shape):
                base = centre[at] * DIMS
                for k in range(NNZ):
                    m += np.bincount(base + INDEX_AT[ctx, k], INDEX_SIGN[ctx, k], minlength=len(m))
    parts = m.reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), pa.array([x.astype("<i8").tobytes() for x in parts], pa.binary())],
                                     ["chunk", "part"])


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, part in zip(b.column("chunk").to_pylist(), b.column("part").to_pylist(), strict=True):
            x = np.frombuffer(part, "<i8")
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                     ["chunk", "part"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIMS unit-length vectors from all of ``docs(text)``."""
    schema = "chunk long, part binary"
    parts = spread(docs.select("text")).mapInArrow(_accumulate, schema)
    # partial sums per group of tasks first, then per chunk; both stream
    parts = parts.repartition(CHUNKS, "chunk").mapInArrow(_add_up, schema)
    m = np.zeros((CHUNKS, ROWS * DIMS // CHUNKS))
    for c, part in ((r[0], r[1]) for r in parts.collect()):
        m[c] += np.frombuffer(part, "<i8")
    m = m.reshape(ROWS, DIMS)
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    data, off = text_buffers(batch.column("text"))
    columns, out = np.ascontiguousarray(vectors.T), []
    for i, j in blocks(off):
        word, shape, doc = units(data[off[i]:off[j]], off[i:j + 1] - off[i])
        n = np.bincount(doc, minlength=j - i)
        x = np.zeros((j - i, 2 * DIMS + 1), np.float32)
        if len(doc):
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            has = doc[at]
            for d in range(DIMS):
                x[has, d] = np.add.reduceat(columns[d][word], at) / n[has]
            # few shapes: their counts times their vectors
            c = np.bincount(doc * SHAPES + shape, minlength=(j - i) * SHAPES).reshape(-1, SHAPES)
            x[:, DIMS:-1] = c @ vectors[:SHAPES] / np.maximum(n, 1)[:, None]
        x[:, -1] = np.log1p(n)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 1), np.float32)


class Network:
    """Two layers, trained with Adam; ``temperature`` from rows held back."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 5):
        self.flat = None
        if len(y) < 10 or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.std
        held = np.arange(len(y)) % 5 == 4
        zt, yt = z[~held], y[~held]
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
             rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        mom, var, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for s in range(0, len(order), 128):
                r = order[s:s + 128]
                a = np.tanh(zt[r] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - yt[r]) / len(r)
                da = np.outer(d, p[2]) * (1 - a * a)
                grads = [zt[r].T @ da + 1e-4 * p[0], da.sum(0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    mom[i] = 0.9 * mom[i] + 0.1 * g
                    var[i] = 0.999 * var[i] + 0.001 * g * g
                    p[i] = p[i] - 3e-3 * (mom[i] / (1 - 0.9 ** t)) / (np.sqrt(var[i] / (1 - 0.999 ** t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, yh = self._logit(x[held]), y[held]
        # smoothed targets: a sample without errors doesn't make the scores certain
        one, zero = (yh.sum() + 1) / (yh.sum() + 2), 1 / ((1 - yh).sum() + 2)
        target = np.where(yh > 0, one, zero)
        grid = np.geomspace(0.25, 16, 80)
        loss = [np.mean(np.logaddexp(0, logit / g) - target * logit / g) for g in grid]
        self.temperature = float(grid[np.argmin(loss)])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a = np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1])
        return a @ self.p[2] + self.p[3][0]

    def prob(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -40, 40)))


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> QualityModel:
    """``docs(doc_id, text)`` give the word vectors, ``labels(doc_id, quality)`` the sample."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    picked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.join(F.broadcast(picked), "doc_id")  # bounded by max_rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality"),
                                              pa.array([r.tobytes() for r in pool(b, sent.value)], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, 2 * DIMS + 1).astype(np.float64)
    order = np.random.default_rng(3).permutation(len(x))
    y = got["y"].to_numpy().astype(np.float64)
    return QualityModel(vectors, Network(x[order], y[order]))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score (a column of that name is replaced)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            m = sent.value
            p = m.network.prob(pool(b, m.vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return spread(docs).mapInArrow(run, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 3, value: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, labels.where(crc_mod("doc_id", mod) != value))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", mod) == value).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
