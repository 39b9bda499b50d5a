"""Text operators over token tables ``(doc_id, pos, token)``.

Tokens come from ``regexp_extract_all`` + ``posexplode`` (JVM side).  Any
rule that looks at neighbouring tokens uses *blocked* windows: positions are
cut into blocks of ``BLOCK`` tokens and the last few tokens of a block are
copied into the next block as context, so a window never spans more than
one block plus the context, however long a document is.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096

# Fixed values (published VADER method, Hutto & Gilbert 2014): the negation
# scalar, the normalisation constant, the weights around "but", and the
# negation words (apostrophe-free forms, since tokens are letter runs).
NEGATION_SCALAR = -0.74
NORMALISATION_ALPHA = 15.0
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope",
    "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "without", "wont", "wouldnt", "rarely", "seldom", "despite",
]

WORD_PATTERN = r"\p{L}+"        # lower-cased letter runs (scoring)
CASED_PATTERN = r"\p{L}+"       # case kept (tagging, entities)


def first_word_position(text: Column, word: str) -> Column:
    """Token position (0-based, tokens = lower-case letter runs) of the first
    occurrence of ``word`` in an already lower-cased text, NULL if absent:
    the number of letter runs before its first whole-word match."""
    pat = rf"(?<!\p{{L}}){word}(?!\p{{L}})"
    at = F.regexp_instr(text, F.lit(pat))
    before = F.size(F.regexp_extract_all(F.substring(text, F.lit(1), at - 1), F.lit(WORD_PATTERN), 0))
    return F.when(at > 0, before)


def tokenize(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD_PATTERN,
             lower: bool = True, out: str = "token", keep=()) -> DataFrame:
    """(doc_id, pos, token, *keep): one row per token; ``keep`` carries
    per-document columns along."""
    from orchard.sources.tables import spread
    text = F.lower(F.col(text_col)) if lower else F.col(text_col)
    return spread(df.select(id_col, text_col, *keep)).select(F.col(id_col).alias("doc_id"), *keep,
                     F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", out))


def any_in_previous(tokens: DataFrame, flag: Column, span: int, out: str,
                    block: int = BLOCK) -> DataFrame:
    """``out`` is true when ``flag`` holds for any of the ``span`` tokens
    before each token of the same document (blocked window)."""
    t = tokens.withColumn("_f", flag.cast("int")).withColumn("_b", F.floor(F.col("pos") / block))
    ctx = (t.where(F.col("pos") % block >= block - span)
           .withColumn("_b", F.col("_b") + 1).withColumn("_ctx", F.lit(True)))
    both = t.withColumn("_ctx", F.lit(False)).unionByName(ctx)
    w = Window.partitionBy("doc_id", "_b").orderBy("pos").rowsBetween(-span, -1)
    return (both.withColumn(out, F.coalesce(F.max("_f").over(w), F.lit(0)) == 1)
            .where(~F.col("_ctx")).drop("_f", "_b", "_ctx"))


def neighbour_flags(tokens: DataFrame, flag: Column, out_prev: str, out_next: str,
                    block: int = BLOCK) -> DataFrame:
    """Flags of the previous and next token (false at document edges), by
    blocked ``lag``/``lead`` with one token of context on each side."""
    t = tokens.withColumn("_f", flag).withColumn("_b", F.floor(F.col("pos") / block))
    prev_ctx = t.where(F.col("pos") % block == block - 1).withColumn("_b", F.col("_b") + 1)
    next_ctx = t.where(F.col("pos") % block == 0).withColumn("_b", F.col("_b") - 1)
    both = (t.withColumn("_ctx", F.lit(False))
            .unionByName(prev_ctx.withColumn("_ctx", F.lit(True)))
            .unionByName(next_ctx.withColumn("_ctx", F.lit(True))))
    w = Window.partitionBy("doc_id", "_b").orderBy("pos")
    return (both.withColumn(out_prev, F.coalesce(F.lag("_f").over(w), F.lit(False)))
            .withColumn(out_next, F.coalesce(F.lead("_f").over(w), F.lit(False)))
            .where(~F.col("_ctx")).drop("_f", "_b", "_ctx"))


def round_half_away(c: Column, n: int) -> Column:
    """Round half away from zero on the binary value,
    sign(x) * floor(|x| * 10^n + 0.5) / 10^n: plain IEEE operations, so every
    engine (and the SQL oracle) gives the same double, ties included."""
    scale = float(10 ** n)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def lexicon_scores(tokens: DataFrame, lexicon: DataFrame, word_col: str = "token",
                   digits: bool = True, but_col: str | None = None) -> DataFrame:
    """neg / neu / pos / compound per document.

    valence: the lexicon value (0 for unknown words); times -0.74 when one
    of the three previous tokens is a negation; times 0.5 before and 1.5
    after the document's first "but".  compound = s / sqrt(s^2 + 15) with s
    the sum; pos/neg/neu are the shares of (v+1 for v>0), |v-1| for v<0 and
    1 for v=0 in their total."""
    lex = lexicon.select(F.col("word").alias(word_col), "valence")
    # positions negated by a negation word: the three after it.  Negation
    # words are rare, so this is a small table joined back on (doc, pos)
    negated = (tokens.where(F.col(word_col).isin(NEGATIONS))
               .select("doc_id", F.explode(F.array(F.col("pos") + 1, F.col("pos") + 2, F.col("pos") + 3)).alias("pos"))
               .distinct().withColumn("_neg", F.lit(True)))
    t = tokens.join(lex, word_col, "left").join(negated, ["doc_id", "pos"], "left") \
        .withColumn("_neg", F.coalesce("_neg", F.lit(False)))
    if but_col:   # first "but" already known per document (see first_word_position)
        t = t.withColumnRenamed(but_col, "_but")
    else:
        but = tokens.where(F.col(word_col) == "but").groupBy("doc_id").agg(F.min("pos").alias("_but"))
        t = t.join(but, "doc_id", "left")
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    v = F.when(F.col("_neg") & (v != 0), v * NEGATION_SCALAR).otherwise(v)
    v = (F.when(F.col("_but").isNull(), v)
         .when(F.col("pos") < F.col("_but"), v * BUT_BEFORE)
         .when(F.col("pos") > F.col("_but"), v * BUT_AFTER).otherwise(v))
    t = t.withColumn("_v", v)
    agg = t.groupBy("doc_id").agg(
        F.sum("_v").alias("_s"),
        F.sum(F.when(F.col("_v") > 0, F.col("_v") + 1).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("_v") < 0, F.col("_v") - 1).otherwise(0.0)).alias("_negs"),
        F.sum(F.when(F.col("_v") == 0, 1.0).otherwise(0.0)).alias("_neu"))
    total = F.col("_pos") + F.abs(F.col("_negs")) + F.col("_neu")
    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORMALISATION_ALPHA)
    share = lambda c: F.when(total > 0, F.abs(c / total)).otherwise(0.0)
    r = (lambda c, n: round_half_away(c, n)) if digits else (lambda c, n: c)
    return agg.select("doc_id", r(share(F.col("_negs")), 3).alias("neg"), r(share(F.col("_neu")), 3).alias("neu"),
                      r(share(F.col("_pos")), 3).alias("pos"), r(compound, 4).alias("compound"))


# Closed word classes of the rule tagger (Penn tag names).
CLOSED_TAGS = {
    "DT": ["the", "a", "an", "this", "that", "these", "those"],
    "CC": ["and", "or", "but", "nor"],
    "TO": ["to"],
    "IN": ["of", "in", "on", "at", "by", "for", "with", "from", "as", "into", "about", "than"],
    "PRP": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"],
    "MD": ["can", "could", "will", "would", "shall", "should", "may", "might", "must"],
    "VBZ": ["is", "has", "does"],
    "VBP": ["are", "am", "have", "do"],
    "VBD": ["was", "were", "had", "did"],
}


def rule_tag(token: Column, pos: Column) -> Column:
    """Part-of-speech by closed-class lists, then capitalisation (not at
    position 0) for proper nouns, then suffixes; NN otherwise."""
    low = F.lower(token)
    expr = None
    for tag, words in CLOSED_TAGS.items():
        cond = low.isin(words)
        expr = F.when(cond, tag) if expr is None else expr.when(cond, tag)
    return (expr.when((pos > 0) & token.rlike(r"^\p{Lu}\p{Ll}"), "NNP")
            .when(low.endswith("ing") & (F.length(low) > 4), "VBG")
            .when(low.endswith("ed") & (F.length(low) > 3), "VBD")
            .when(low.endswith("ly") & (F.length(low) > 3), "RB")
            .when(low.endswith("s") & (F.length(low) > 3), "NNS")
            .otherwise("NN"))


def softmax_columns(cols: Sequence[Column], names: Sequence[str], digits: int = 6) -> list[Column]:
    m = F.greatest(*cols)
    exps = [F.exp(c - m) for c in cols]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [F.round(e / total, digits).alias(n) for e, n in zip(exps, names)]


# --- in-row form: a document is one row, its tokens one array ------------

def proper_noun_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start_pos, end_pos, n_tokens, first_token, last_token): maximal
    runs of proper-noun tokens (rule tagger), found inside each document's
    row (no shuffle): a run starts at a proper noun whose predecessor is not
    one and ends at one whose successor is not one.  Predecessor/successor
    flags come from whole-array shifts, the boundary tokens are filtered
    inside the array, and only (start, end) pairs are exploded, so the work
    is linear in the document and exploded rows never carry its arrays."""
    from orchard.sources.tables import spread
    closed = [w for ws in CLOSED_TAGS.values() for w in ws]
    base = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"),
                       F.regexp_extract_all(F.col(text_col), F.lit(CASED_PATTERN), 0).alias("_toks"))
    base = base.where(F.size("_toks") > 0).select(
        "doc_id", "_toks",
        F.transform("_toks", lambda t, i: (i > 0) & t.rlike(r"^\p{Lu}\p{Ll}") & ~F.lower(t).isin(closed)).alias("_nnp"))
    toks, nnp = F.col("_toks"), F.col("_nnp")
    n = F.size(toks)
    prev = F.concat(F.array(F.lit(False)), F.slice(nnp, 1, n - 1))
    nxt = F.concat(F.slice(nnp, 2, n - 1), F.array(F.lit(False)))
    start_f = F.zip_with(nnp, prev, lambda a, b: a & ~b)
    end_f = F.zip_with(nnp, nxt, lambda a, b: a & ~b)
    z = F.arrays_zip(toks.alias("tok"), F.sequence(F.lit(0), n - 1).alias("i"), start_f.alias("s"), end_f.alias("e"))
    mid = base.select("doc_id", z.alias("_z")).select(
        "doc_id", F.filter("_z", lambda x: x["s"]).alias("_S"), F.filter("_z", lambda x: x["e"]).alias("_E"))
    runs = mid.select("doc_id", F.explode(F.arrays_zip("_S", "_E")).alias("_r"))
    s, e = F.col("_r._S"), F.col("_r._E")
    return runs.select("doc_id", s["i"].alias("start_pos"), e["i"].alias("end_pos"),
                       (e["i"] - s["i"] + 1).cast("bigint").alias("n_tokens"),
                       s["tok"].alias("first_token"), e["tok"].alias("last_token"))
