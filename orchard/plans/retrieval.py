"""Document retrieval workflow: chunking (recursive and fixed-width), chunk
embeddings, a named vector collection, exact and LSH top-k, multi-query
retrieval and prompt assembly.

Inputs: ``documents`` (doc_id, text), ``embeddings`` (vec_id, embedding,
label) and ``benchmark`` (item_id, text) as the questions.  Queries over
``embeddings`` are label centroids (one question per label) and, for the
multi-query form, centroids of five disjoint slices of each label (the
question's five variants); all are derived from the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orchard.operators.retrieval import (assemble_context, centroids, fixed_chunks, hashed_tfidf_embedder,
                                         lsh_topk, multiquery_union, text_chunks, vector_topk)
from orchard.operators.vector_index import build_index, search_index
from orchard.session import scratch_path
from orchard.sources.files import written
from orchard.sources.tables import table

CHUNK_SIZE, CHUNK_OVERLAP = 7500, 100
TOP_K = 4
N_VARIANTS = 5
# fixed value: the answer prompt of the workflow
PROMPT_TEMPLATE = """Answer the question based ONLY on the following context:
{context}
Question: {question}
"""


def label_questions(spark, d):
    e = table(spark, d, "embeddings")
    return centroids(e, ["label"], "embedding").withColumnRenamed("label", "question_id")


def variant_questions(spark, d):
    e = table(spark, d, "embeddings").withColumn("variant_no", (F.col("vec_id") % N_VARIANTS).cast("int"))
    return centroids(e, ["label", "variant_no"], "embedding").withColumnRenamed("label", "question_id")


def q_chunk_fixed(spark, d):
    return fixed_chunks(table(spark, d, "documents"), "doc_id", "text", CHUNK_SIZE, CHUNK_OVERLAP)


def q_chunk_documents(spark, d):
    return text_chunks(table(spark, d, "documents"), "doc_id", "text", CHUNK_SIZE, CHUNK_OVERLAP)


def _chunk_vectors(spark, d):
    # written once: the embedder's fit, the vectors and the contexts each pass over the chunks
    chunks = written(text_chunks(table(spark, d, "documents"), "doc_id", "text", CHUNK_SIZE, CHUNK_OVERLAP), "chunks")
    embed = hashed_tfidf_embedder(chunks, "chunk")
    return embed, embed(chunks).withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"),
                                                                    F.col("chunk_no").cast("string")))


def q_embed_chunks(spark, d):
    _, vecs = _chunk_vectors(spark, d)
    return vecs.select("doc_id", "chunk_no", "embedding")


def write_collection(df, path: str):
    """A named vector collection: (id, label, embedding) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def q_vector_index(spark, d):
    """Write the vectors as a named collection (Parquet in the shared
    scratch folder) and read the collection back; ``drop_path`` removes a
    collection (``DROP ... IF EXISTS``)."""
    path = scratch_path(spark, "collection-local-rag")
    write_collection(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path)
    return spark.read.parquet(path)


def q_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vector_topk(e, "vec_id", "embedding", label_questions(spark, d), ["question_id"], "centroid", TOP_K)


def q_vector_collection_topk(spark, d):
    """The same rows from a stored collection with a cell index."""
    path = scratch_path(spark, "collection-cells")
    build_index(table(spark, d, "embeddings"), "vec_id", "embedding", path)
    return search_index(spark, path, label_questions(spark, d), ["question_id"], "centroid", TOP_K) \
        .withColumnRenamed("id", "vec_id")


def q_vector_multiquery(spark, d):
    e = table(spark, d, "embeddings")
    hits = vector_topk(e, "vec_id", "embedding", variant_questions(spark, d), ["question_id", "variant_no"],
                       "centroid", TOP_K)
    return multiquery_union(hits, "question_id", "vec_id")


def q_vector_topk_lsh(spark, d):
    e = table(spark, d, "embeddings")
    return lsh_topk(e, "vec_id", "embedding", label_questions(spark, d), "question_id", "centroid", TOP_K)


def q_rag_prompts(spark, d):
    """Benchmark questions -> top-k chunks -> context -> filled prompt."""
    embed, vecs = _chunk_vectors(spark, d)
    questions = embed(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "question") \
        .select("item_id", "question", "embedding")
    # written: few rows a question, whose size then lets the chunks be joined without moving them
    hits = written(vector_topk(vecs, "chunk_id", "embedding", questions, ["item_id"], "embedding", TOP_K), "hits")
    ctx = assemble_context(hits.join(vecs.select("chunk_id", "chunk"), "chunk_id"), "item_id",
                           [F.col("rank"), F.col("chunk_id")], "chunk")
    prompt = F.replace(F.replace(F.lit(PROMPT_TEMPLATE), F.lit("{context}"), F.col("context")),
                       F.lit("{question}"), F.col("question"))
    return questions.select("item_id", "question").join(ctx, "item_id", "left").select(
        "item_id", prompt.alias("prompt"))


QUERIES = {
    "chunk_fixed": q_chunk_fixed,
    "chunk_documents": q_chunk_documents,
    "embed_chunks": q_embed_chunks,
    "vector_index": q_vector_index,
    "vector_topk": q_vector_topk,
    "vector_collection_topk": q_vector_collection_topk,
    "vector_multiquery": q_vector_multiquery,
    "vector_topk_lsh": q_vector_topk_lsh,
    "rag_prompts": q_rag_prompts,
}

_CENTROID = """WITH dims AS (SELECT label, {extra} unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label AS question_id, {extra2} list(m ORDER BY d) AS centroid FROM (
  SELECT label, {extra2} d, avg(x) AS m FROM dims GROUP BY ALL) g GROUP BY ALL),
dist AS (SELECT c.* EXCLUDE (centroid), e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid) AS distance
  FROM embeddings e CROSS JOIN c),
top AS (SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY question_id {extra2} ORDER BY distance, vec_id) AS INTEGER) AS rank
  FROM dist) r WHERE rank <= 4)"""

ORACLE = {
    "chunk_fixed": """SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_start AS INTEGER) AS chunk_start,
        substring(text, chunk_start + 1, 7500) AS chunk FROM (
          SELECT doc_id, text, generate_subscripts(st, 1) - 1 AS chunk_no, unnest(st) AS chunk_start FROM (
            SELECT doc_id, text, range(0, (CASE WHEN length(text) <= 7500 THEN 1
                   ELSE 1 + CAST(ceil((length(text) - 7500) / 7400) AS BIGINT) END - 1) * 7400 + 1, 7400) AS st
            FROM documents) a) b""",
    "vector_index": "SELECT vec_id, label, embedding FROM embeddings",
    "vector_topk": _CENTROID.format(extra="", extra2="") +
    "\nSELECT question_id, rank, vec_id, round(distance, 6) AS distance FROM top",
    "vector_collection_topk": _CENTROID.format(extra="", extra2="") +
    "\nSELECT question_id, rank, vec_id, round(distance, 6) AS distance FROM top",
    "vector_multiquery": _CENTROID.format(extra="CAST(vec_id % 5 AS INTEGER) AS variant_no,",
                                          extra2="variant_no,").replace("PARTITION BY question_id variant_no,",
                                                                        "PARTITION BY question_id, variant_no") +
    """\nSELECT question_id, vec_id, min(round(distance, 6)) AS best_distance, count(*) AS n_variants
       FROM top GROUP BY question_id, vec_id""",
}
