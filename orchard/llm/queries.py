"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.sources.tables import table


def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others; 20 best inner products."""
    from orchard.llm.topk import exact_topk, quantised
    return exact_topk(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def q_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written to token files and read back from them."""
    import public_tokenizers

    from orchard.llm.token_store import read_token_files, write_token_files
    manifest, path = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, path)


def q_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    from orchard.llm.langid import language_ids
    return language_ids(table(spark, sf_dir, "documents"))


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a Jaccard index of at least 0.85."""
    from orchard.llm.jaccard import Rule, near_copies
    return near_copies(table(spark, sf_dir, "documents"), Rule(4, 85, 100))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    from orchard.llm.quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed on one of 64 shards."""
    from orchard.llm.sharding import SHARDS, place
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of every benchmark item found in every document."""
    from orchard.llm.decontam import digest, find_contamination
    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def q_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the backoff model and the unigram base."""
    from orchard.llm.lm import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"))


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into bins of 2,048 token ids."""
    import public_tokenizers

    from orchard.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def q_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, by its own notice or from the nearest directory."""
    from orchard.llm.licenses import document_licences
    return document_licences(table(spark, sf_dir, "documents"))


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with a repeated tail."""
    from orchard.llm.runs import digest, find_runs, planted
    return digest(find_runs(table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))))


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its source's tree, with proofs and folded tampered leaves."""
    from orchard.llm.merkle import document_manifest
    return document_manifest(table(spark, sf_dir, "documents"))


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents (without white space) and the row of each that stays."""
    from orchard.llm.dedup import exact_copies
    return exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_topk": q_topk,
    "op2_token_store": q_token_store,
    "op3_language_id": q_language_id,
    "op4_ngram_jaccard": q_jaccard,
    "op5_quality": q_quality,
    "op6_sharding": q_sharding,
    "op7_decontaminate": q_decontaminate,
    "op8_lm_scoring": q_lm,
    "op9_packing": q_packing,
    "op10_licences": q_licences,
    "op11_periodic_runs": q_runs,
    "op12_merkle_manifest": q_merkle,
    "op13_exact_dedup": q_dedup,
}


def _oracles() -> dict[str, str]:
    from orchard.llm import decontam, dedup, licenses, merkle, sharding, topk
    return {"op1_exact_topk": topk.ORACLE, "op6_sharding": sharding.oracle(), "op7_decontaminate": decontam.ORACLE,
            "op10_licences": licenses.oracle(), "op12_merkle_manifest": merkle.ORACLE, "op13_exact_dedup": dedup.ORACLE}


ORACLE = _oracles()
