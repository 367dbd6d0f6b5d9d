"""Retrieval and vector queries (SRC5, JOI1, JOI2, JOI6, AGG1-2, FLT3-4, TOP1-3, VEC1-5, PRJ1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V
from ..operators import encode, knn, pooling
from ..sources import tables as TB
from . import sqlkit as Q
from ._registry import query, round_doubles

# Threshold used where the default 0.6 would leave the check without hits on
# random-direction vectors; the text-search thresholds keep the default.


def _text_search(spark, sf, k, summary_type=None, min_similarity=None):
    docs = TB.store_documents(spark, sf)
    if summary_type:
        # the predicate sits below the encoder: pushed into the Parquet scan, and rows of
        # other types are never encoded or scored
        docs = docs.where(F.col("embedding_type") == F.lit(summary_type))
    vecs = docs.select("id", encode.hashed_bow("content").alias("embedding"))
    qs = TB.benchmark_queries(spark, sf)
    hits = knn.search(docs, vecs, qs, k, min_similarity=min_similarity, require_document=False)
    return round_doubles(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "content",
                                     "source", "embedding_type", "similarity"))


_HIT_COLS = """SELECT query_id, rank::INTEGER AS rank, h.id, d.text AS content, d.source,
           d.lang AS embedding_type, round(similarity, 6) AS similarity
    FROM hits h JOIN documents d ON d.doc_id = h.id"""


@query("vector_search", sql=f"WITH {Q.bow_knn(K.SEARCH_TOP_K)} {_HIT_COLS}")
def vector_search(spark, sf):
    """TOP1/JOI2/PRJ1: every benchmark question, encoded, against every document; top 3 by
    cosine, ties by id; hit projection id, content, source, type, similarity."""
    return _text_search(spark, sf, K.SEARCH_TOP_K)


_EN = "lang = 'en'"


@query("vector_search_filtered", sql=f"WITH {Q.bow_knn(K.SEARCH_TOP_K, d_filter=_EN)} {_HIT_COLS}")
def vector_search_filtered(spark, sf):
    """FLT3: the type predicate (lang plays the type) applied before the top-k."""
    return _text_search(spark, sf, K.SEARCH_TOP_K, summary_type="en")


@query("similarity_threshold",
       sql=f"WITH {Q.bow_knn(K.ANSWER_TOP_K)} {_HIT_COLS} WHERE similarity >= {K.MIN_SIMILARITY}")
def similarity_threshold(spark, sf):
    """FLT4/TOP3: top 4 for answering, then similarity >= 0.6 after the top-k."""
    return _text_search(spark, sf, K.ANSWER_TOP_K, min_similarity=K.MIN_SIMILARITY)


_CENTROIDS_SQL = """
    ex AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x,
                  unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings),
    cent AS (SELECT label, dim, avg(x) AS c FROM ex GROUP BY 1, 2),
    dots AS (SELECT cent.label AS query_id, ex.vec_id AS id, sum(c * x) AS dot FROM cent
             JOIN ex ON ex.dim = cent.dim GROUP BY 1, 2),
    qn AS (SELECT label, sum(c * c) AS n2 FROM cent GROUP BY 1),
    vn AS (SELECT vec_id, sum(x * x) AS n2 FROM ex GROUP BY 1),
    sims AS (SELECT query_id, id, dot / sqrt(qn.n2 * vn.n2) AS similarity FROM dots
             JOIN qn ON qn.label = query_id JOIN vn ON vn.vec_id = id
             WHERE id IN (SELECT doc_id FROM documents) AND qn.n2 > 0 AND vn.n2 > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
               FROM sims)"""


@query("vector_search_batch", sql=f"""WITH {_CENTROIDS_SQL}
    SELECT query_id, rank::INTEGER AS rank, id, round(similarity, 6) AS similarity
    FROM ranked WHERE rank <= {K.SEARCH_TOP_K}""")
def vector_search_batch(spark, sf):
    """TOP2: a batch of queries in one job. The queries are the label centroids of the given
    embeddings (mean pooling per label); each finds its 3 nearest stored vectors that have a
    document (JOI1)."""
    vecs = TB.store_vectors(spark, sf)
    labels = TB.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    cents = pooling.group_mean(vecs.join(labels, "id"), "label", "embedding")
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    hits = knn.knn(vecs.join(docs, "id", "left_semi"), cents, K.SEARCH_TOP_K, id_col="id",
                   qid_col="label", qvec_col="embedding")
    return round_doubles(hits.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), "id",
                                     "similarity"))


@query("docs_with_vectors", sql="""
    SELECT d.doc_id AS id, d.source, d.lang AS embedding_type, len(e.embedding)::INTEGER AS dim,
           round(sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 6) AS norm
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def docs_with_vectors(spark, sf):
    """JOI1: documents inner-join vectors on id (1:1); AQE picks the join strategy."""
    d = TB.store_documents(spark, sf)
    v = TB.store_vectors(spark, sf)
    return round_doubles(d.join(v, "id").select("id", "source", "embedding_type",
                                                F.size("embedding").alias("dim"),
                                                V.l2_norm("embedding").alias("norm")))


@query("store_counts", sql="""
    SELECT 'documents' AS store_table, count(*)::BIGINT AS n_rows FROM documents
    UNION ALL SELECT 'embeddings', count(*)::BIGINT FROM embeddings""")
def store_counts(spark, sf):
    """AGG1/AGG2: document and embedding counts."""
    d = TB.store_documents(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit("documents").alias("store_table"), "n_rows")
    e = TB.store_vectors(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit("embeddings").alias("store_table"), "n_rows")
    return d.unionByName(e)


@query("store_integrity", sql="""
    SELECT 'document_without_vector' AS kind, doc_id AS id FROM documents
    WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL
    SELECT 'vector_without_document', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def store_integrity(spark, sf):
    """JOI6: documents without a vector and vectors without a document (anti joins)."""
    d = TB.store_documents(spark, sf).select("id")
    v = TB.store_vectors(spark, sf).select("id")
    return (d.join(v, "id", "left_anti").select(F.lit("document_without_vector").alias("kind"), "id")
             .unionByName(v.join(d, "id", "left_anti").select(F.lit("vector_without_document").alias("kind"),
                                                              "id")))


@query("encode_text", sql=f"""
    WITH v AS {Q.bow('documents', 'doc_id', 'text')},
    n AS (SELECT id, sqrt(sum(cnt * cnt)) AS norm FROM v GROUP BY 1)
    SELECT v.id AS doc_id, bucket, cnt AS count, round(cnt / norm, 6) AS weight FROM v JOIN n USING (id)""")
def encode_text(spark, sf):
    """VEC1: every document through the default encoder, shown as its non-zero entries."""
    d = TB.table(spark, sf, "documents")
    v = encode.encode(d.select("doc_id", "text"), "text")
    return round_doubles(encode.sparse_terms(v, "doc_id"))


@query("l2_normalize", sql="""
    WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e,
                      sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
    SELECT vec_id, unnest(generate_series(0, len(e) - 1)) AS dim,
           round(unnest(list_transform(e, lambda x: x / norm)), 6) AS value
    FROM n WHERE norm > 0""")
def l2_normalize(spark, sf):
    """VEC3: unit vectors of the given embeddings, one row per component."""
    e = TB.table(spark, sf, "embeddings")
    u = e.select("vec_id", V.l2_normalize("embedding").alias("u"))
    return round_doubles(u.select("vec_id", F.posexplode("u").alias("dim", "value"))
                          .select("vec_id", F.col("dim").cast("bigint").alias("dim"), "value"))


@query("cosine_pairs", sql="""
    SELECT a.vec_id, b.vec_id AS next_id,
           CASE WHEN list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) > 0
                 AND list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0
                THEN round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    """VEC4: cosine similarity (double) of each stored vector with the next id's vector;
    an equi-join, so the work is linear in the table."""
    e = TB.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                   F.col("embedding").alias("e2"))
    return round_doubles(e.join(nxt, "vec_id").select("vec_id", "next_id",
                                                      V.cosine("embedding", "e2").alias("cosine")))


@query("softmax_entropy", sql="""
    WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(embedding::DOUBLE[]) AS mx FROM embeddings),
    z AS (SELECT vec_id, e, mx, list_sum(list_transform(e, lambda x: exp(x - mx))) AS z FROM m),
    p AS (SELECT vec_id, list_transform(e, lambda x: exp(x - mx) / z) AS p FROM z)
    SELECT vec_id,
           round(-list_sum(list_transform(p, lambda x: x * ln(least(greatest(x, 1e-10), 1.0)))) / ln(2.0), 6) AS entropy,
           0.0::DOUBLE AS varentropy
    FROM p""")
def softmax_entropy(spark, sf):
    """VEC5: entropy in bits of softmax(logits) over the whole vector; the variance of a
    scalar entropy is always 0."""
    e = TB.table(spark, sf, "embeddings")
    return round_doubles(e.select("vec_id", V.softmax_entropy_bits("embedding").alias("entropy"),
                                  F.lit(0.0).alias("varentropy")))


@query("masked_avg_pool", sql="""
    WITH ex AS (SELECT e.label, coalesce((d.lang = 'en')::INTEGER, 0) AS m,
                       unnest(e.embedding::DOUBLE[]) AS x, unnest(generate_series(0, len(e.embedding) - 1)) AS dim
                FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)
    SELECT label, dim, round(CASE WHEN sum(m) > 0 THEN sum(x * m) / sum(m) END, 6) AS value
    FROM ex GROUP BY 1, 2""")
def masked_avg_pool(spark, sf):
    """VEC2: masked mean pooling of vectors per label; the mask is 1 where the vector's
    document is English. A label whose mask is all zero gives NULL, not a division error."""
    e = TB.table(spark, sf, "embeddings")
    d = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    x = e.join(d, "vec_id", "left").select("label", "embedding",
                                           F.coalesce((F.col("lang") == "en").cast("int"), F.lit(0)).alias("m"))
    return round_doubles(pooling.masked_mean(x, "label", "embedding", "m"))
