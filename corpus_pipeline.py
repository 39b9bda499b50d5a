"""Training-corpus pipeline over ``documents``.

Five stages, each one operator of ``orchard.llm`` over all rows the stage before
kept: language identification (rows without a language go), quality classifier
(rows it rejects go), n-gram Jaccard join (one row of each group of near copies
stays), benchmark decontamination (contaminated rows go), best-fit packing (the
rows that are left, as pieces in bins).

All but the last stage return the columns of their input.  A stage's input may
hold nulls, repeated rows and extra columns; the operators' docstrings say what
becomes of them.  The near-copy stage gives every row a number of its own and
decides row by row, null doc_ids included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.llm import decontam, jaccard, langid, packing, quality
from orchard.llm.common import discard, numbered, semi_join, stored
from orchard.session import ensure_checkpoint_dir
from orchard.sources.tables import table

MIN_QUALITY = 0.5
NEAR = jaccard.Rule(k=5, num=80, den=100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or null, and those no learned language fits: by likeness
    to the learned languages, not by the score, which only compares them with each other."""
    model = langid.train(docs, ~langid.held_out())
    named = _kept_aside(docs, lambda d: langid.identify(d, model), ["lang_pred", "fit"])
    return named.where((F.col("_op.lang_pred") != "und") & (F.col("_op.fit") >= 0)).select("_row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under ``MIN_QUALITY``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = _kept_aside(docs, lambda d: quality.score(d, model), ["score"])
    return scored.where(F.col("_op.score") >= MIN_QUALITY).select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row of the smallest id (null ids last), then hash of the text;
    rows are linked by their own texts, so rows that share an id can lie in different groups.
    Rows without words are copies of rows with the same id and text."""
    rows = numbered(docs, "doc_id", F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_hash"))
    found = stored(jaccard.near_copies(rows.select("doc_id", "text"), NEAR, unique=True), "pipeline-groups")
    member = found.where("n_shingles > 0 and component_id <> doc_id").select("doc_id", "component_id")
    member = member.unionByName(member.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "doc_id"))["doc_id"].alias("kept")
    long = rows.select("doc_id", "_id", "_hash")
    kept = long.join(member, "doc_id").groupBy("component_id").agg(first)
    gone = member.join(kept, "component_id").where("doc_id <> kept").select("doc_id")
    # without words there is no component: the same id and text
    blank = semi_join(long, found.where("n_shingles = 0").select("doc_id"), ["doc_id"]).where("_id is not null")
    single = blank.groupBy("_id", "_hash").agg(F.min("doc_id").alias("kept"))
    gone = gone.unionByName(blank.join(single, ["_id", "_hash"]).where("doc_id <> kept").select("doc_id"))
    return semi_join(rows, stored(gone, "pipeline-copies"), ["doc_id"], "left_anti").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a window of a benchmark item occurs."""
    benchmark = table(spark, sf_dir, "benchmark")
    found = _kept_aside(docs, lambda d: decontam.scan_rows(d, benchmark), ["n_hit"])
    return found.where(F.col("_op.n_hit") == 0).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in bins of 2,048 token ids."""
    import public_tokenizers
    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def _kept_aside(docs: DataFrame, operator, columns: list[str]) -> DataFrame:
    """(_row: the input's columns, _op: the operator's), so that no name can clash."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    return operator(row).select("_row", F.struct(*columns).alias("_op"))


STAGES = [
    ("language ID", language),
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# learned and sequential stages have no SQL form; tests/llm/test_llm.py checks decisions of them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
