"""Lexicon sentiment by the published rules of Hutto & Gilbert (2014): valences from a
lexicon table, raised by capitals and degree words, turned by negations, weighted around
"but", with emphasis by exclamation and question marks.

Texts are scored by batches, with Arrow and NumPy: a batch is cut into words once, what a rule
asks of a word (its valence, its degree, whether it negates) is found once for each different
word, and each rule is then one step over all words of the batch that the lexicon has, whose
neighbours stand beside them.  While the counted lexicon fits, the tasks take it along.  A larger
one is asked by blocks of texts: the texts are dealt to blocks of bounded size, each block asks
for the different words it holds, and scores its texts with the valences found, so no word is
shuffled per occurrence.  Only sums per text leave a batch.  Valences are rounded to a
millionth before they are added, so sums do not depend on order.

Words are the runs between ASCII white space, without ASCII punctuation at their ends
(runs of which two characters or fewer would be left stay as they are).  A null or blank text
scores 0 everywhere.
"""

from __future__ import annotations

from string import punctuation
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.operators.text import NEGATIONS, round_half_away

# Fixed values of the published method.
DEGREE = 0.293
CAPITALS = 0.733
NEGATED = -0.74
DAMP = {2: 0.95, 3: 0.9}  # of degree words two and three places before
BUT = (0.5, 1.5)
EXCLAMATION, QUESTION, QUESTIONS = 0.292, 0.18, 0.96
ALPHA = 15.0
INCREASING = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "effing",
    "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely", "fabulously",
    "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully", "fuckin", "fucking",
    "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible", "incredibly", "intensely", "major", "majorly",
    "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total",
    "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
]
DECREASING = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional",
    "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta", "sortof", "sort-of",
]
DECREASING_PHRASES = ["just enough", "kind of", "sort of"]
MORE_NEGATIONS = [
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't", "don't", "hadn't", "hasn't", "haven't", "isn't",
    "mightn't", "mustn't", "needn't", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "won't", "wouldn't",
]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

SPLIT = r"[\x20\x09-\x0D]+"
ENDS = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
LEXICON_ROWS = 1 << 18
BLOCK_CHARS = 1 << 24  # characters of the texts of a block, about
BATCH_BYTES = 1 << 23  # of texts scored at once, or one longer text
MICRO = 1_000_000

# The words that rules name have codes: 0 is any other word, 1 none (beyond the ends of the text).
NONE = 1
NAMED = sorted({"at", "but", "doubt", "kind", "least", "never", "no", "nor", "of", "or", "so", "this", "very", "without"}
               | {w for x in [*IDIOMS, *DECREASING_PHRASES] for w in x.split()})
CODE = {w: i + 2 for i, w in enumerate(NAMED)}
SUMS = ["excl", "ques", "n", "s", "p", "g", "k"]


def _phrases(values: dict[str, float], size: int) -> np.ndarray:
    """Values by the codes of ``size`` words, NaN where they are no phrase; shorter ones end at the end of the text."""
    table = np.full((len(NAMED) + 2,) * size, np.nan)
    for phrase, value in values.items():
        codes = [CODE[w] for w in phrase.split()]
        if len(codes) <= size:
            table[(*codes, *[NONE] * (size - len(codes)))] = value
    return table


IDIOMS2, IDIOMS3 = _phrases(IDIOMS, 2), _phrases(IDIOMS, 3)
DECREASING2 = ~np.isnan(_phrases(dict.fromkeys(DECREASING_PHRASES, 1.0), 2))


def _batches(texts: pa.Array) -> Iterator[slice]:
    """Cuts of the rows, of about ``BATCH_BYTES`` each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every word by the row of its text and by its number among the different words, and those."""
    runs = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    n = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    flat = runs.flatten().dictionary_encode()
    at, different = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    blank = pc.index(different, "").as_py()  # of a blank text
    if blank >= 0:
        row, at = row[at != blank], at[at != blank]
    stripped = pc.ascii_trim(different, characters=punctuation)
    if not pc.all(pc.string_is_ascii(different)).as_py():  # a line end of Unicode at the end stays behind what is stripped
        lines = pc.extract_regex(different, "(?s)^(?P<w>.*)(?P<l>[\u0085\u2028\u2029])$")
        cut = pc.binary_join_element_wise(pc.ascii_trim(pc.struct_field(lines, "w"), characters=punctuation), pc.struct_field(lines, "l"), "")
        stripped = pc.coalesce(cut, stripped)
    return row, at, pc.if_else(pc.less_equal(pc.utf8_length(stripped), 2), different, stripped)


def _lower(words: pa.Array) -> pa.Array:
    """As Spark's lower(): these two letters are not mapped alone."""
    low, other = pc.utf8_lower(words), pc.match_substring_regex(words, "[\u0130\u03a3]")
    if pc.any(other).as_py():
        low = pc.replace_with_mask(low, other, pa.array([w.lower() for w in words.filter(other).to_pylist()], low.type))
    return low


class _Words:
    """What the rules ask of each different word; the last number stands for none."""

    def __init__(self, words: pa.Array, lexicon: pa.Array, valences: np.ndarray):
        low = _lower(words)

        def place(values, missing: int) -> np.ndarray:
            found = pc.fill_null(pc.index_in(low, value_set=values), missing).to_numpy(zero_copy_only=False)
            return np.append(found, np.int32(missing))

        def flag(values: pa.Array) -> np.ndarray:
            return np.append(values.to_numpy(zero_copy_only=False), False)

        self.v = np.append(valences, np.nan)[place(lexicon, len(valences))]
        self.known = ~np.isnan(self.v)
        steps = [DEGREE] * len(INCREASING) + [-DEGREE] * len(DECREASING) + [0.0]
        self.step = np.array(steps)[place(pa.array(INCREASING + DECREASING), len(steps) - 1)]
        self.up = flag(pc.and_(pc.match_substring_regex(words, r"\p{Lu}"), pc.invert(pc.match_substring_regex(words, r"\p{Ll}"))))
        self.no = flag(pc.or_(pc.is_in(low, value_set=pa.array(NEGATIONS + MORE_NEGATIONS)), pc.match_substring(low, "n't")))
        self.code = place(pa.array(NAMED), -2) + 2
        self.code[-1] = NONE
        self.none = len(words)


def _is(codes: np.ndarray, *words: str) -> np.ndarray:
    return np.isin(codes, [CODE[w] for w in words])


def _adjusted(x: _Words, word: np.ndarray, near: dict[str, np.ndarray], caps: np.ndarray, but: np.ndarray) -> np.ndarray:
    """The valences of ``word`` after the rules, each of which takes what the one before left.
    ``near``: the words before (p1, p2, p3) and after (f1, f2); ``caps``: whether capitals count;
    ``but``: -1 before the first "but" of the text, 1 after it."""
    low, c = x.code[word], {k: x.code[v] for k, v in near.items()}
    plain = {k: (v != x.none) & ~x.known[v] for k, v in near.items()}
    raised = lambda y, sign: np.where(sign > 0, y + CAPITALS, y - CAPITALS)
    w = x.v[word]
    no = _is(c["p1"], "no") | _is(c["p2"], "no") | (_is(c["p3"], "no") & _is(c["p1"], "or", "nor"))
    w = np.where(no, w * NEGATED, np.where(_is(low, "no") & x.known[near["f1"]], 0.0, w))
    w = np.where(x.up[word] & caps, raised(w, w), w)
    for k in (1, 2, 3):
        p, nearer = f"p{k}", [c[f"p{j}"] for j in range(1, k)]
        step = x.step[near[p]]
        by = np.where(w < 0, -step, step)
        by = np.where(x.up[near[p]] & caps, raised(by, w), by) * DAMP.get(k, 1.0)
        w = np.where(plain[p] & (step != 0), w + by, w)
        never, doubted = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for y in nearer:
            never |= _is(c[p], "never") & _is(y, "so", "this")
            doubted |= _is(c[p], "without") & _is(y, "doubt")
        turned = np.where(x.no[near[p]], w * NEGATED, w)
        w = np.where(plain[p], np.where(never, w * 1.25, np.where(doubted, w, turned)), w)
    idiom = IDIOMS3[low, c["f1"], c["f2"]]
    for other in (IDIOMS2[low, c["f1"]], IDIOMS2[c["p1"], low], IDIOMS3[c["p2"], c["p1"], low], IDIOMS2[c["p2"], c["p1"]],
                  IDIOMS3[c["p3"], c["p2"], c["p1"]], IDIOMS2[c["p3"], c["p2"]]):
        idiom = np.where(np.isnan(idiom), other, idiom)
    w = np.where(plain["p3"] & ~np.isnan(idiom), idiom, w)
    less = DECREASING2[c["p3"], c["p2"]].astype(np.float64) + DECREASING2[c["p2"], c["p1"]]
    w = np.where(plain["p3"], w - less * DEGREE, w)
    w = np.where(plain["p1"] & _is(c["p1"], "least") & ~_is(c["p2"], "at", "very"), w * NEGATED, w)
    return np.where(but < 0, w * BUT[0], np.where(but > 0, w * BUT[1], w))


def _text_sums(texts: pa.Array, lexicon: pa.Array, valences: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text its signs, its words, the sum of its valences in millionths, those of the positive and of the
    negative ones, each raised by one, and how many are not 0."""
    row, at, different = _split(texts)
    x, size = _Words(different, lexicon, valences), len(texts)
    n = np.bincount(row, minlength=size)
    first = np.cumsum(n) - n
    ups = np.bincount(row[x.up[at]], minlength=size)
    caps = (ups > 0) & (ups < n)
    buts = np.flatnonzero(_is(x.code, "but")[at])[::-1]  # the first of a text is kept last
    but = np.full(size, -1)
    but[row[buts]] = buts
    here = np.flatnonzero((x.known & (x.step == 0))[at])

    def beside(k: int) -> np.ndarray:
        there = here + k
        inside = (there >= first[row[here]]) & (there < (first + n)[row[here]])
        return np.where(inside, at[np.clip(there, 0, len(at) - 1)], x.none)

    here = here[~(_is(x.code[at[here]], "kind") & _is(x.code[beside(1)], "of"))]
    of = row[here]
    near = {"p1": beside(-1), "p2": beside(-2), "p3": beside(-3), "f1": beside(1), "f2": beside(2)}
    w = _adjusted(x, at[here], near, caps[of], np.where(but[of] < 0, 0, np.sign(here - but[of])))
    m = (np.sign(w) * np.floor(np.abs(w) * MICRO + 0.5)).astype(np.int64)
    ends = np.searchsorted(of, np.arange(size + 1))

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]
        return sums[1:] - sums[:-1]

    signs = [pc.fill_null(pc.count_substring(texts, sign), 0).to_numpy(zero_copy_only=False) for sign in "!?"]
    return dict(zip(SUMS, [*signs, n, total(m), total(np.where(m > 0, m + MICRO, 0)), total(np.where(m < 0, MICRO - m, 0)), total(m != 0)], strict=True))


def _array(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else pa.array(column, column.type)


def _scored(ids: pa.Array, texts: pa.Array, lexicon: pa.Array, valences: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, *SUMS) of the texts that have words."""
    for cut in _batches(texts):
        sums = _text_sums(texts[cut], lexicon, valences)
        whole = pa.RecordBatch.from_arrays([ids[cut], *[pa.array(sums[c], pa.int64()) for c in SUMS]], names=["id", *SUMS])
        yield whole.filter(pa.array(sums["n"] > 0))


def _valences(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    table = table.filter(pc.and_(table["word"].is_valid(), table["valence"].is_valid()))
    return _array(table["word"]), table["valence"].to_numpy()


def _told(texts: DataFrame, lexicon: DataFrame, schema: str) -> DataFrame:
    """The sums of ``texts(id, text)`` by a lexicon that every task takes along."""
    from orchard.sources.tables import spread
    words, valences = _valences(lexicon.select("word", "valence").toArrow())

    def run(batches):
        for b in batches:
            yield from _scored(b.column(0), b.column(1), words, valences)

    return spread(texts).mapInArrow(run, schema)


def _asked(texts: DataFrame, lexicon: DataFrame, block_chars: int, schema: str) -> DataFrame:
    """The sums of ``texts(id, text)``, whose blocks ask a large lexicon for their different words."""
    from math import ceil
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # smaller blocks ask for the same words more often
    n = max(4 * texts.sparkSession.sparkContext.defaultParallelism, ceil(total / block_chars))
    # both readers take the same columns, so that the texts are exchanged once
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))).repartition("block").select("block", "id", "text")

    def ask(rows: pa.Table) -> pa.Table:
        texts = _array(rows["text"])
        found = [pc.unique(_lower(_split(texts[cut])[2])) for cut in _batches(texts)]
        words = pc.unique(pa.concat_arrays(found)) if found else pa.array([], pa.string())
        return pa.Table.from_arrays([pa.repeat(rows["block"][0], len(words)), words], names=["block", "word"])

    def look_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        batches = _scored(_array(rows["id"]), _array(rows["text"]), *_valences(found))
        return pa.Table.from_batches(batches, pa.schema([pa.field("id", rows["id"].type), *[pa.field(c, pa.int64()) for c in SUMS]]))

    words = dealt.groupBy("block").applyInArrow(ask, "block long, word string")
    hits = words.join(lexicon.select("word", "valence").hint("merge"), "word").select(F.col("block").alias("of"), "word", "valence")
    return dealt.groupBy("block").cogroup(hits.groupBy("of")).applyInArrow(look_up, schema)


def polarity_scores(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                    lexicon_rows: int = LEXICON_ROWS, block_chars: int = BLOCK_CHARS, repeats: DataFrame | None = None) -> DataFrame:
    """(id, neg, neu, pos, compound) of every text with a word; ids are unique.  ``lexicon``:
    (word, valence), one row per lower-case word; up to ``lexicon_rows`` rows it is broadcast,
    beyond that blocks of texts of about ``block_chars`` characters ask for their words.
    ``repeats``: (id), a text counts as often as its id is there, or once; texts are scored before."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{c} long" for c in SUMS]])
    few = lexicon.limit(lexicon_rows + 1).count() <= lexicon_rows
    rows = _told(rows, lexicon, schema) if few else _asked(rows, lexicon, block_chars, schema)
    if repeats is not None:
        rows = rows.join(repeats.select("id"), "id", "left")
    # rows of one id take the sums of all of them, rows without an id take none
    same = Window.partitionBy("id", F.when(F.col("id").isNull(), F.hash("excl", "ques", "n")))
    sums = rows.select("id", "excl", "ques", "n", *[F.when(F.col("id").isNotNull(), F.sum(c).over(same)).otherwise(0).alias(c) for c in "spgk"])
    sums = sums.select("id", "excl", "ques", *"spg", (F.col("n") - F.col("k")).alias("u"))
    emph = (F.least("excl", F.lit(4)) * EXCLAMATION
            + F.when(F.col("ques") <= 1, 0.0).when(F.col("ques") <= 3, F.col("ques") * QUESTION).otherwise(QUESTIONS))
    sums = sums.select("id", emph.alias("emph"), *[(F.col(c) / float(MICRO)).alias(c) for c in "spg"], F.col("u").cast("double").alias("u"))
    s = F.col("s") + F.when(F.col("s") > 0, F.col("emph")).when(F.col("s") < 0, -F.col("emph")).otherwise(0.0)
    p = F.col("p") + F.when(F.col("p") > F.col("g"), F.col("emph")).otherwise(0.0)
    g = F.col("g") + F.when(F.col("p") < F.col("g"), F.col("emph")).otherwise(0.0)
    done = sums.select("id", s.alias("s"), p.alias("p"), g.alias("g"), "u")
    total = F.col("p") + F.col("g") + F.col("u")
    share = lambda c: round_half_away(F.col(c) / total, 3)
    compound = F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA)
    return done.select("id", share("g").alias("neg"), share("u").alias("neu"), share("p").alias("pos"),
                       round_half_away(compound, 4).alias("compound"))


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _away(x: str, n: int) -> str:
    k = float(10 ** n)
    return f"(CAST(sign({x}) AS DOUBLE) * floor(abs({x}) * {k} + 0.5) / {k})"


def oracle_ctes(texts: str = "reviews", lexicon: str = "lexicon") -> str:
    """DuckDB CTEs that end in ``scored`` (id, neg, neu, pos, compound): the same rules over
    windows of a token table."""
    idiom = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IDIOMS.items()) + " END"
    w = "OVER (PARTITION BY id ORDER BY pos)"
    back = "coalesce(" + ", ".join(idiom(x) for x in (
        "l1 || ' ' || low", "l2 || ' ' || l1 || ' ' || low", "l2 || ' ' || l1", "l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2")) + ")"
    ahead = "coalesce(" + idiom("low || ' ' || f1 || ' ' || f2") + ", " + idiom("low || ' ' || f1") + ")"

    def degree(k, v):
        d = f" * {DAMP[k]}" if k in DAMP else ""
        return (f"CASE WHEN l{k} IS NOT NULL AND v{k} IS NULL AND s{k} <> 0 THEN {v} + (CASE WHEN {v} < 0 THEN -s{k} ELSE s{k} END"
                f" + CASE WHEN u{k} AND caps THEN CASE WHEN {v} > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE 0.0 END){d} ELSE {v} END")

    plain = lambda k: f"l{k} IS NOT NULL AND v{k} IS NULL"
    phrase = lambda x: f"CASE WHEN coalesce({x} IN {_in(DECREASING_PHRASES)}, false) THEN 1 ELSE 0 END"
    lags = ", ".join(f"lag(low, {k}) {w} AS l{k}, lag(v, {k}) {w} AS v{k}, lag(step, {k}) {w} AS s{k}, lag(up, {k}) {w} AS u{k}, lag(no, {k}) {w} AS n{k}"
                     for k in (1, 2, 3))
    strip = f"regexp_replace(w, '{ENDS}', '', 'g')"
    return f"""sw AS (SELECT id, len(text) - len(replace(text, '!', '')) AS excl, len(text) - len(replace(text, '?', '')) AS ques,
    list_filter(regexp_split_to_array(text, '{SPLIT}'), lambda x: x <> '') AS ws FROM {texts}),
sx AS (SELECT id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM sw),
sy AS (SELECT id, pos, CASE WHEN length({strip}) <= 2 THEN w ELSE {strip} END AS word FROM sx),
sz AS (SELECT y.id, y.pos, lower(y.word) AS low, regexp_matches(y.word, '\\p{{Lu}}') AND NOT regexp_matches(y.word, '\\p{{Ll}}') AS up,
    x.valence AS v, CASE WHEN lower(y.word) IN {_in(INCREASING)} THEN {DEGREE} WHEN lower(y.word) IN {_in(DECREASING)} THEN -{DEGREE} ELSE 0.0 END::DOUBLE AS step,
    lower(y.word) IN {_in(NEGATIONS + MORE_NEGATIONS)} OR contains(lower(y.word), 'n''t') AS no
    FROM sy y LEFT JOIN {lexicon} x ON x.word = lower(y.word)),
sa AS (SELECT id, count(*) AS n, count(*) FILTER (up) AS ups, min(pos) FILTER (low = 'but') AS but FROM sz GROUP BY id),
sl AS (SELECT *, {lags}, lead(low, 1) {w} AS f1, lead(low, 2) {w} AS f2, lead(v, 1) {w} AS fv FROM sz),
s0 AS MATERIALIZED (SELECT sl.*, sa.but, sa.ups > 0 AND sa.ups < sa.n AS caps, CASE
    WHEN coalesce(l1 = 'no', false) OR coalesce(l2 = 'no', false) OR coalesce(l3 = 'no' AND l1 IN ('or', 'nor'), false) THEN v * {NEGATED}
    WHEN low = 'no' AND fv IS NOT NULL THEN 0.0 ELSE v END AS w0
    FROM sl JOIN sa USING (id) WHERE v IS NOT NULL AND step = 0 AND NOT (low = 'kind' AND coalesce(f1 = 'of', false))),
s1 AS MATERIALIZED (SELECT *, CASE WHEN up AND caps THEN w0 + CASE WHEN w0 > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE w0 END AS w1 FROM s0),
s2 AS MATERIALIZED (SELECT *, {degree(1, 'w1')} AS w2 FROM s1),
s3 AS MATERIALIZED (SELECT *, CASE WHEN {plain(1)} AND n1 THEN w2 * {NEGATED} ELSE w2 END AS w3 FROM s2),
s4 AS MATERIALIZED (SELECT *, {degree(2, 'w3')} AS w4 FROM s3),
s5 AS MATERIALIZED (SELECT *, CASE WHEN {plain(2)} AND l2 = 'never' AND l1 IN ('so', 'this') THEN w4 * 1.25
    WHEN {plain(2)} AND l2 = 'without' AND l1 = 'doubt' THEN w4 WHEN {plain(2)} AND n2 THEN w4 * {NEGATED} ELSE w4 END AS w5 FROM s4),
s6 AS MATERIALIZED (SELECT *, {degree(3, 'w5')} AS w6 FROM s5),
s7 AS MATERIALIZED (SELECT *, CASE WHEN {plain(3)} AND l3 = 'never' AND (l2 IN ('so', 'this') OR l1 IN ('so', 'this')) THEN w6 * 1.25
    WHEN {plain(3)} AND l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt') THEN w6 WHEN {plain(3)} AND n3 THEN w6 * {NEGATED} ELSE w6 END AS w7 FROM s6),
s8 AS MATERIALIZED (SELECT *, CASE WHEN {plain(3)} THEN coalesce({ahead}, {back}, w7) ELSE w7 END AS w8 FROM s7),
s9 AS MATERIALIZED (SELECT *, CASE WHEN {plain(3)} THEN w8 - ({phrase("l3 || ' ' || l2")} + {phrase("l2 || ' ' || l1")}) * {DEGREE} ELSE w8 END AS w9 FROM s8),
st AS MATERIALIZED (SELECT *, CASE WHEN v1 IS NULL AND l1 = 'least' AND coalesce(l2, '') NOT IN ('at', 'very') THEN w9 * {NEGATED} ELSE w9 END AS wt FROM s9),
sb AS MATERIALIZED (SELECT id, CASE WHEN but IS NULL THEN wt WHEN pos < but THEN wt * {BUT[0]} WHEN pos > but THEN wt * {BUT[1]} ELSE wt END AS x FROM st),
sm AS (SELECT id, CAST(CAST(sign(x) AS DOUBLE) * floor(abs(x) * {MICRO} + 0.5) AS BIGINT) AS m FROM sb),
sg AS (SELECT id, sum(m) AS s, sum(m + {MICRO}) FILTER (m > 0) AS p, sum({MICRO} - m) FILTER (m < 0) AS g, count(*) FILTER (m <> 0) AS k FROM sm GROUP BY id),
sh AS (SELECT sa.id, CAST(coalesce(s, 0) AS DOUBLE) / {float(MICRO)} AS s, CAST(coalesce(p, 0) AS DOUBLE) / {float(MICRO)} AS p,
    CAST(coalesce(g, 0) AS DOUBLE) / {float(MICRO)} AS g, CAST(n - coalesce(k, 0) AS DOUBLE) AS u,
    CAST(least(excl, 4) AS DOUBLE) * {EXCLAMATION} + CASE WHEN ques <= 1 THEN 0.0 WHEN ques <= 3 THEN CAST(ques AS DOUBLE) * {QUESTION} ELSE {QUESTIONS} END AS emph
    FROM sa JOIN sw USING (id) LEFT JOIN sg USING (id)),
si AS (SELECT id, s + CASE WHEN s > 0 THEN emph WHEN s < 0 THEN -emph ELSE 0.0 END AS s, p + CASE WHEN p > g THEN emph ELSE 0.0 END AS p,
    g + CASE WHEN p < g THEN emph ELSE 0.0 END AS g, u FROM sh),
scored AS (SELECT id, {_away("g / (p + g + u)", 3)} AS neg, {_away("u / (p + g + u)", 3)} AS neu, {_away("p / (p + g + u)", 3)} AS pos,
    {_away(f"s / sqrt(s * s + {ALPHA})", 4)} AS compound FROM si)"""
