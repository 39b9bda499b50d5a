"""Language-model scoring with a weighted backoff automaton.

Model.  Words and an end mark per document are the tokens.  Unigrams are
add-half smoothed: (c + 0.5) / (N + 0.5 (V + 1)).  Bigrams and trigrams that occur
``min_count`` times or more in the training tokens become arcs with an
absolutely discounted probability (c - D) / c(history); what the arcs of a
history leave over is spread over all other words by its backoff weight
(1 - sum of arcs) / (1 - sum of the same words one order below), so every
history's probabilities sum to one.  ``min_count`` is an absolute count: the model
grows with the corpus.

Automaton.  States are the root, one state per word that starts an arc, and
one per bigram that starts an arc; a state's failure arc leads to the state of
its shorter history and costs its backoff weight.  Documents of a block are
traversed together, one token each per step, left to right, every document
carrying its state and its running log10 probability.

Scale.  Counting covers every n-gram of every training document; nothing is
withheld.  A run of about ``RUN`` tokens sends its distinct bigrams, then, when those
are arcs, its distinct trigrams, packed, to buckets by key; a bucket (about 2^20 tokens
of the corpus, whatever its size) is counted exactly by one task.  The arcs lie in a
table of the shared folder, in the same buckets, and never travel whole: documents are
stored in blocks, a block sends the keys it holds to the buckets, gets back which of them the table has with
their values, and builds the part of the automaton it can reach.  Both go on in passes
(``PASSES``) over all buckets and all blocks, so that one part is in the shuffle at a time.  Of the words, the ``dictionary``
commonest at most (by powers of two of the count) go to the executors as a
broadcast; all others are asked for like n-grams.

Defined cases: a null or empty text has the end mark as its only token; texts
without training data score with N = V = 0; repeated rows are scored (and, in
training, counted) each; null ids count as the empty text's crc32; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import BASE, HashTable, U, blocks, crc_mod, discard, mix, release, spread, stored, text_buffers, word_hashes

END = U(0xE5D0E5D0E5D0E5D1)    # the end token's key
START = U(0x57A2757A2757A275)  # history before the first token
HISTORY, LAST, FLIP = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, U(0x3333333333333333)
RUN = 1 << 21  # tokens whose n-grams are combined before they are sent
BUCKET = 1 << 20  # tokens of the corpus a bucket
BLOCK = 4 << 20  # bytes of text scored together (a longer document alone)
PASSES = 3  # bits of a key that say in which pass it is asked for; blocks are scored in two


def _pair(a, b):
    with np.errstate(over="ignore"):
        return mix(a * U(HISTORY) + b * U(LAST) + U(2))


def _history(key, b):
    """The ``a`` of ``_pair(a, b)``: every step of the key can be undone."""
    inv = lambda c: U(pow(c, -1, 1 << 64))
    with np.errstate(over="ignore"):
        x = key ^ (key >> U(31)) ^ (key >> U(62))
        x = x * inv(0x94D049BB133111EB)
        x = x ^ (x >> U(27)) ^ (x >> U(54))
        x = x * inv(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(30)) ^ (x >> U(60))
        return (x - BASE - U(2) - b * U(LAST)) * inv(HISTORY)


def token_block(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of a block's documents, each ended by END, and their offsets."""
    h, doc, _, _ = word_hashes(data, off)
    n = len(off) - 1
    size = np.bincount(doc, minlength=n) + 1
    out = np.full(len(h) + n, END)
    at = np.cumsum(size)
    ends = np.zeros(len(out), bool)
    ends[at - 1] = True
    out[~ends] = h
    return out, np.concatenate([[0], at])


def ngram_keys(tok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the key of (previous, token) and of (two before, previous, token);
    START stands before a document, and a first token has no trigram (key 0)."""
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[off[:-1]] = START
    two = _pair(prev, tok)
    hist = np.zeros_like(tok)  # key of the bigram that ends at the previous token
    hist[1:] = two[:-1]
    three = _pair(hist ^ FLIP, tok)
    three[off[:-1]] = 0
    return two, three


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a position of each, and how often each occurs."""
    order = np.argsort(x)
    s = x[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], order[at], np.diff(np.concatenate([at, [len(s)]]))


def _planes(*columns: np.ndarray) -> bytes:
    """Byte planes of equally long columns, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _columns(raw: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(widths), [], 0
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).reshape(-1).view(t))
        at += n * w
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """As ``_planes``; the first column, sorted uint64, by its steps."""
    return _planes(np.diff(columns[0], prepend=U(0)), *columns[1:])


def _unpack(raw: bytes, *types) -> list[np.ndarray]:
    out = _columns(raw, *types)
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0], dtype=U)
    return out


def _pack_values(x: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct values and the place of each value among them, or, where most differ, the values alone."""
    values, place = np.unique(x.view(U), return_inverse=True)
    return (_planes(x), b"") if 2 * len(values) > len(x) else (_pack(values), _planes(place.astype(np.uint32)))


def _values(values: bytes, place: bytes) -> np.ndarray:
    return _unpack(values, U)[0].view(np.float64)[_columns(place, np.uint32)[0]] if place else _columns(values, np.float64)[0]


def _marks(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions in a sorted table, or -1."""
    at = np.searchsorted(table, keys)
    hit = at < len(table)
    hit[hit] = table[at[hit]] == keys[hit]
    return np.where(hit, at, -1)


def _bucket(bits: int, key: str = "key") -> Column:
    """The first ``bits`` bits of a key."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 63 - bits), 1)


def _cuts(keys: np.ndarray, bits: int):
    """(bucket, from, to) of the buckets of sorted keys."""
    if not len(keys):
        return ()
    number = (keys >> U(63 - bits)) >> U(1)
    at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return zip(number[at].astype(np.int64).tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).view(U) if isinstance(x, pa.Array) else x.to_numpy().view(U)


def _runs(batches):
    """(token keys, offsets) of about ``RUN`` tokens of whole documents each."""
    toks, offs, n = [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        data, off = text_buffers(batch.column("text"))
        for i, j in blocks(off):
            tok, at = token_block(data[off[i]:off[j]], off[i:j + 1] - off[i])
            toks.append(tok), offs.append(at[1:] + n)
            n += len(tok)
            if n >= RUN:
                yield np.concatenate(toks), np.concatenate(offs)
                toks, offs, n = [], [np.zeros(1, np.int64)], 0
    if n:
        yield np.concatenate(toks), np.concatenate(offs)


def _word_runs(batches):
    for tok, _ in _runs(batches):
        key, _, n = _firsts(tok)
        yield pa.RecordBatch.from_arrays([_long(key), pa.array(n)], ["key", "n"])


def _gram_runs(bits: int, order: int):
    """Rows (bucket, grams, lasts) of the bigrams or trigrams: packed key, place of the last word in ``lasts``, count."""
    def run(batches):
        for tok, off in _runs(batches):
            key, at, n = _firsts(ngram_keys(tok, off)[order - 2])
            some = key != 0
            key, last, n = key[some], tok[at[some]], n[some].astype(np.uint32)
            for b, i, j in _cuts(key, bits):
                lasts, place = np.unique(last[i:j], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int64()), pa.array([_pack(key[i:j], place.astype(np.uint32), n[i:j])], pa.binary()),
                     pa.array([_pack(lasts)], pa.binary())], ["bucket", "grams", "lasts"])
    return run


def _count_bucket(least: int, order: int):
    """Exact counts of a bucket's n-grams; those of ``least`` or more."""
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for raw, words in zip(table["grams"].to_pylist(), table["lasts"].to_pylist(), strict=True):
            key, place, n = _unpack(raw, U, np.uint32, np.uint32)
            parts.append((key, _unpack(words, U)[0][place], n))
        key, last, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.argsort(key)
        key, n = key[o], n[o].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, at)
        at, n = at[n >= least], n[n >= least]
        key, last = key[at], last[o[at]]
        a = _history(key, last)
        if order == 3:
            a ^= FLIP
        return pa.table([_long(key), _long(a), _long(last), pa.array(n)], names=["key", "a", "b", "n"])
    return run


def _lower(batches):
    """Adds ``low``, the key of the bigram (v, b)."""
    for b in batches:
        low = _pair(_keys(b.column("v")), _keys(b.column("b")))
        yield pa.RecordBatch.from_arrays([*b.columns, _long(low)], [*b.schema.names, "low"])


class Automaton:
    """Root 0, then one state per history.  ``arc`` maps (state, word) to (log10
    probability, next state); ``fail`` and ``bow`` are the failure arcs.  It may be
    the part of a model that some documents can reach."""

    def __init__(self, total, vocab, words, counts, two, three, hist):
        """two, three: dicts of arrays key, a (history key), b (word key), log and, for three,
        low (key of the bigram it ends with); hist: key, last (a bigram's last word, else 0), log."""
        self.total, self.vocab = int(total), int(vocab)
        self.denominator = self.total + 0.5 * (self.vocab + 1)
        self.words, self.index = words, HashTable(words)
        self.uni = np.log10((counts + 0.5) / self.denominator)
        table = HashTable(hist["key"])
        state = lambda key: table.find(key) + 1
        self.fail = np.concatenate([[0], np.where(hist["last"] == 0, 0, state(hist["last"]))]).astype(np.int32)
        self.bow = np.concatenate([[0.0], hist["log"]])
        self.start = int(state(np.array([START], U))[0])
        self.word_state = np.append(state(words), 0).astype(np.int32)  # the last entry is "not in it"
        arcs, logs, following = [], [], []
        for grams, longest in ((two, "key"), (three, "low")):
            # after an arc the longest history that is a state: the last two words, else the last one
            pair, one = state(grams[longest]), state(grams["b"])
            arcs.append(self._key(state(grams["a"]), self.index.find(grams["b"])))
            logs.append(grams["log"])
            following.append(np.where(pair > 0, pair, one))
        self.arc = HashTable(np.concatenate(arcs))
        self.arc_log = np.concatenate(logs)
        self.arc_next = np.concatenate(following).astype(np.int32)

    @staticmethod
    def _key(state, word):
        return mix((np.asarray(state).astype(U) << U(32)) | np.asarray(word).astype(U))

    def traverse(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each document's dictionary tokens plus all backoff
        weights; tokens outside the dictionary (-1) add only the weights here."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        start, size = off[:-1][order], size[order]
        longest = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
        state = np.full(len(size), self.start, np.int32)
        total = np.zeros(len(size))
        for t in range(int(size.max(initial=0))):
            live = int(longest[t])  # documents are sorted by length: the live ones come first
            w = ids[start[:live] + t]
            s = state[:live].copy()
            gain = np.zeros(live)
            todo = np.flatnonzero(s > 0)
            done = np.zeros(live, bool)
            while len(todo):
                known = w[todo] >= 0
                arc = np.full(len(todo), -1, np.int64)
                arc[known] = self.arc.find(self._key(s[todo[known]], w[todo[known]]))
                hit = arc >= 0
                got = todo[hit]
                gain[got] += self.arc_log[arc[hit]]
                s[got] = self.arc_next[arc[hit]]
                done[got] = True
                miss = todo[~hit]
                gain[miss] += self.bow[s[miss]]
                s[miss] = self.fail[s[miss]]
                todo = miss[s[miss] > 0]
            root = np.flatnonzero(~done)
            rw = w[root]
            gain[root] += np.where(rw >= 0, self.uni[np.maximum(rw, 0)] if len(self.uni) else 0.0, 0.0)
            s[root] = self.word_state[rw]  # -1 is the last entry: no state
            state[:live] = s
            total[:live] += gain
        out = np.zeros(len(size))
        out[order] = total
        return out


class Model:
    """The tables of a trained model: ``values`` (bucket, key, kind, x, y, and, if whole, a, b, low), where x
    is a word's count or an arc's log10 probability and y the log10 backoff weight of a history."""

    def __init__(self, values: DataFrame, bits: int, total: int, vocab: int, least: int):
        self.values, self.bits, self.total, self.vocab, self.least = values, bits, total, vocab, least


def fit(docs: DataFrame, min_count: int = 2, dictionary: int = 1 << 20, discount: float = 0.5, theta: float = 0.0,
        whole: bool = False) -> Model:
    """Model of ``docs(text)``; ``theta`` asks for a relative frequency besides ``min_count``, ``whole`` for
    the words of every arc, which a block of documents knows itself."""
    docs = spread(docs.select(F.col("text").cast("string").alias("text")))
    words = stored(docs.mapInArrow(_word_runs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    sizes = {r[0]: (r[1], r[2]) for r in
             words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*"), F.sum("n")).collect()}
    vocab, total = sum(v for v, _ in sizes.values()), sum(n for _, n in sizes.values())
    least, kept = 1, 0
    for k in sorted(sizes, reverse=True):
        kept += sizes[k][0]
        if kept > dictionary:
            least = 1 << (int(k) + 1)
            break
    end = F.lit(int(END.view(np.int64)))
    start = F.lit(int(START.view(np.int64)))
    bits = max(0, math.ceil(math.log2(max(1, total) / BUCKET)))
    count = max(min_count, math.ceil(theta * total))

    def arcs(order: int) -> DataFrame:
        grams = docs.mapInArrow(_gram_runs(bits, order), "bucket long, grams binary, lasts binary")
        out = stored(grams.groupBy("bucket").applyInArrow(_count_bucket(count, order), "key long, a long, b long, n long"), "lm-arcs")
        release(docs.sparkSession)  # the n-grams, the largest shuffle, are gone before the next one
        return out

    left = lambda p: F.greatest(1 - F.sum(p), F.lit(1e-12))
    p = (F.col("n") - discount) / F.col("c")
    # START stands as often as the end mark
    before = words.unionByName(words.where(F.col("key") == end).select(start.alias("key"), "n"))
    counted = arcs(2)
    two = counted.join(before.select(F.col("key").alias("a"), F.col("n").alias("c")), "a").select("key", "a", "b", "n", p.alias("p"))
    two = two.join(words.select(F.col("key").alias("b"), ((F.col("n") + 0.5) / F.lit(total + 0.5 * (vocab + 1))).alias("u")), "b")
    two = stored(two, "lm-two")
    discard(counted)
    release(docs.sparkSession)
    bow2 = two.groupBy("a").agg(F.log10(left("p") / left("u")).alias("y"))
    # an n-gram's shorter ones occur as often at least, so they are arcs themselves
    counted = arcs(3)
    three = counted.join(two.select(F.col("key").alias("a"), F.col("n").alias("c"), F.col("b").alias("v")), "a").select(
        "key", "a", "b", "v", p.alias("p"))
    three = three.mapInArrow(_lower, "key long, a long, b long, v long, p double, low long").drop("v")
    three = stored(three.join(two.select(F.col("key").alias("low"), F.col("p").alias("q")), "low"), "lm-three")
    discard(counted)
    release(docs.sparkSession)
    bow3 = three.groupBy("a").agg(F.log10(left("p") / left("q")).alias("y"))
    none = F.lit(0).cast("long")
    weigh = lambda t, bow: t.join(bow.select(F.col("a").alias("key"), "y"), "key", "left")
    cols = ["key", "kind", "a", "b", "low", "x", "y"]
    values = (weigh(before.select("key", F.lit(1).alias("kind"), none.alias("a"), none.alias("b"), none.alias("low"),
                                  F.col("n").cast("double").alias("x")), bow2).select(cols)
              .unionByName(weigh(two.select("key", F.lit(2).alias("kind"), "a", "b", none.alias("low"), F.log10("p").alias("x")), bow3).select(cols))
              .unionByName(three.select("key", F.lit(3).alias("kind"), "a", "b", "low", F.log10("p").alias("x"),
                                        F.lit(None).cast("double").alias("y"))))
    if not whole:
        values = values.drop("a", "b", "low")
    values = stored(values.withColumn("bucket", _bucket(bits)), "lm-values")
    discard(words, two, three)
    return Model(values, bits, total, vocab, least)


def train(docs: DataFrame, theta: float = 0.0, min_count: int = 2):
    """(the whole model as one automaton, its word keys, their counts): for models that fit one process."""
    model = fit(docs, min_count, theta=theta, whole=True)
    t = model.values.toArrow()
    kind, key, x = t["kind"].to_numpy(), _keys(t["key"]), t["x"].to_numpy()
    y = t["y"].to_numpy()
    cols = {"key": key, "a": _keys(t["a"]), "b": _keys(t["b"]), "low": _keys(t["low"]), "log": x}
    two, three = ({c: v[kind == k] for c, v in cols.items()} for k in (2, 3))
    is_hist, word = ~np.isnan(y), (kind == 1) & (key != START)
    hist = {"key": key[is_hist], "last": cols["b"][is_hist], "log": y[is_hist]}
    return Automaton(model.total, model.vocab, key[word], x[word], two, three, hist), key[word], x[word]


class _Block:
    """Tokens of a block's documents and the distinct keys it asks for, all or those of a pass:
    words that are not ``known``, bigrams, trigrams."""

    def __init__(self, words: bytes, place: bytes, off: list[int], known: np.ndarray, bits: int = 0, turn: int = 0):
        words, self.off = _unpack(words, U)[0], np.array(off)
        self.tok = words[_columns(place, np.uint32)[0]]
        self.words = np.append(words, START)
        self.two, self.three = ngram_keys(self.tok, self.off)
        now = lambda keys: keys[keys >> U(64 - bits) == turn] if bits else keys
        some = now(self.words)
        self.common = _find(known, some)
        self.rare = some[self.common < 0]
        self.keys2, self.at2, _ = _firsts(now(self.two))
        keys3, at3, _ = _firsts(now(self.three))
        self.keys3, self.at3 = keys3[keys3 != 0], at3[keys3 != 0]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys, sorted, and where each stands among words, bigrams and trigrams."""
        keys = np.concatenate([self.rare, self.keys2, self.keys3])
        order = np.argsort(keys)
        return keys[order], order


def score(docs: DataFrame, model: Model, keep: list[str], last: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens, n_known, train_tokens, base_score, score per row of ``docs``;
    ``last``: the model scores nothing else, and its table goes when it has answered."""
    spark, bits, denominator = docs.sparkSession, model.bits, model.total + 0.5 * (model.vocab + 1)
    total, vocab = model.total, model.vocab
    top = model.values.where((F.col("kind") == 1) & (F.col("x") >= model.least)).select("key", "x", "y").toArrow()
    order = np.argsort(_keys(top["key"]))
    sent = spark.sparkContext.broadcast((_keys(top["key"])[order], top["x"].to_numpy()[order], top["y"].to_numpy()[order]))
    work = spread(docs.select(*keep, F.col("text").cast("string").alias("text")))
    types = {f.name: f.dataType.simpleString() for f in work.schema.fields if f.name != "text"}

    def cut(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            # documents of like length together: a block takes as many steps as its longest has tokens
            batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
            data, off = text_buffers(batch.column("text"))
            for i, j in blocks(off, BLOCK):
                tok, at = token_block(data[off[i]:off[j]], off[i:j + 1] - off[i])
                words, place = np.unique(tok, return_inverse=True)
                lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(c).slice(i, j - i)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([_pack(words)], pa.binary()),
                     pa.array([_planes(place.astype(np.uint32))], pa.binary()),
                     pa.array([at.tolist()], pa.list_(pa.int64())), *lists], ["block", "words", "place", "off", *keep])
                number += 1

    lists = ", ".join(f"`{c}` array<{t}>" for c, t in types.items())
    # the block's number only has to be the same on every later read, and the blocks are stored
    parts = stored(work.mapInArrow(cut, f"block long, words binary, place binary, off array<long>, {lists}"), "lm-blocks")

    turns = min(bits, PASSES)

    def ask(turn: int):
        def run(batches):
            for batch in batches:
                rows = (batch.column(c).to_pylist() for c in ("block", "words", "place", "off"))
                for number, words, place, off in zip(*rows, strict=True):
                    keys, _ = _Block(words, place, off, sent.value[0], turns, turn).asked()
                    for b, i, j in _cuts(keys, bits):
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([number], pa.int64()),
                                                          pa.array([_pack(keys[i:j])], pa.binary())], ["bucket", "block", "keys"])
        return run

    def answer(asked: pa.Table, have: pa.Table) -> pa.Table:
        """Per block that has any: marks of the asked keys found, in their order, the values x and, marked in turn, y of these."""
        index, x, y = HashTable(_keys(have["key"])), have["x"].to_numpy(), have["y"].to_numpy()
        out = []
        for bucket, number, raw in zip(*(asked[c].to_pylist() for c in ("bucket", "block", "keys")), strict=True):
            at = index.find(_unpack(raw, U)[0])
            hit = at >= 0
            if hit.any():
                hx, hy = x[at[hit]], y[at[hit]]
                some = ~np.isnan(hy)
                out.append((number, bucket, np.packbits(hit).tobytes(), *_pack_values(hx), np.packbits(some).tobytes(), *_pack_values(hy[some])))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(found.types)], schema=found)

    found = pa.schema([("block", pa.int64()), ("bucket", pa.int64()),
                       *((c, pa.binary()) for c in ("hit", "x", "x_at", "some", "y", "y_at"))])
    answers = []
    for turn in range(1 << turns):
        asked = parts.select("block", "words", "place", "off").mapInArrow(ask(turn), "bucket long, block long, keys binary")
        have = model.values.where(F.shiftright("bucket", bits - turns) == turn).select("bucket", "key", "x", "y")
        got = asked.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(
            answer, "block long, bucket long, hit binary, x binary, x_at binary, some binary, y binary, y_at binary")
        answers.append(stored(got, "lm-answers"))

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        top, top_x, top_y = sent.value
        for row in range(block.num_rows):
            part = _Block(*(block[c][row].as_py() for c in ("words", "place", "off")), top)
            tok, off = part.tok, part.off
            keys, order = part.asked()
            cut = {b: (i, j) for b, i, j in _cuts(keys, bits)}
            x, y = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
            for bucket, hit, *vx, some, vy, vy_at in zip(*(got[c].to_pylist() for c in found.names[1:]), strict=True):
                i, j = cut[bucket]
                at = order[i:j][_marks(hit, j - i)]
                x[at] = _values(*vx)
                y[at[_marks(some, len(at))]] = _values(vy, vy_at)
            ends = [len(part.rare), len(part.rare) + len(part.keys2)]
            (n1, x2, x3), (y1, y2, _) = np.split(x, ends), np.split(y, ends)
            rare = part.common < 0
            n, wy = np.full(len(rare), np.nan), np.full(len(rare), np.nan)
            n[rare], wy[rare] = n1, y1
            n[~rare], wy[~rare] = top_x[part.common[~rare]], top_y[part.common[~rare]]
            words, seen = part.words, ~np.isnan(n[:-1])
            here = words[:-1][seen]
            h2, h3 = part.at2[~np.isnan(x2)], part.at3[~np.isnan(x3)]
            prev = np.concatenate([[START], tok[:-1]])
            prev[off[:-1]] = START
            two = {"key": part.two[h2], "a": prev[h2], "b": tok[h2], "log": x2[~np.isnan(x2)]}
            three = {"a": part.two[h3 - 1], "b": tok[h3], "low": part.two[h3], "log": x3[~np.isnan(x3)]}
            isw, is2 = ~np.isnan(wy), ~np.isnan(y2)
            hist = {"key": np.concatenate([words[isw], part.keys2[is2]]),
                    "last": np.concatenate([np.zeros(int(isw.sum()), U), tok[part.at2[is2]]]),
                    "log": np.concatenate([wy[isw], y2[is2]])}
            m = Automaton(total, vocab, here, n[:-1][seen], two, three, hist)
            ids = m.index.find(tok)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            hit = ids >= 0
            unknown = np.bincount(doc[~hit], minlength=len(off) - 1) * math.log10(0.5 / denominator)
            base = np.bincount(doc[hit], m.uni[ids[hit]] if hit.any() else None, minlength=len(off) - 1) + unknown
            kept = [block[c].combine_chunks().slice(row, 1).flatten() for c in keep]
            out.append(pa.table([*kept, pa.array(np.diff(off)), pa.array(np.bincount(doc[hit], minlength=len(off) - 1)),
                                 pa.array(np.full(len(off) - 1, total)), pa.array(base.astype(float)), pa.array(m.traverse(ids, off) + unknown)],
                                names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + \
        ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores, every = [], functools.reduce(DataFrame.union, answers)
    passes = 1 << min(1, turns)
    if last:
        discard(model.values)
    for turn in range(passes):
        now, got = (t.where(F.pmod(F.hash("block"), F.lit(passes)) == turn).groupBy("block") for t in (parts, every))
        scores.append(stored(now.cogroup(got).applyInArrow(finish, schema), "lm-scores"))
    discard(parts, *answers)
    return functools.reduce(DataFrame.union, scores)


def lm_scores(docs: DataFrame, mod: int = 5, held: int = 1, min_count: int = 2, dictionary: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (crc_mod("doc_id", mod) == held).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), min_count, dictionary)
    return score(rows, model, ["doc_id", "held_out"], last=True)
