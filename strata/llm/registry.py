"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can
express the whole result. Each query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned quality rules over every document."""
    from .quality import quality_table
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, exactly or with few edits."""
    from .decontam import leaks
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from .packing import packed
    return packed(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has too, removed from every document."""
    from .suffix import dedup_spans
    return dedup_spans(table(spark, sf_dir, "documents"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learned from four fifths of them."""
    from .ppm import scores
    return scores(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the compiled transducer."""
    from .tokencount import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of every document, as read back from the binary shards."""
    from .feistel import training_order
    return training_order(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    from .urltree import judge, labelled_pages
    return judge(labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns, and what the randomness tests add."""
    from .secret_scan import secret_table
    return secret_table(table(spark, sf_dir, "documents")).drop("n_random")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    from pyspark.sql import functions as F

    from .negatives import hard_negatives
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations."""
    from .prefix_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a Jaccard similarity of 0.9."""
    from .jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_best_fit_packing, op3_quality_rules, op4_suffix_dedup,
                                   op5_ppm_scores, op6_token_counts, op7_training_order, op8_simhash,
                                   op9_url_filter, op10_secret_scan, op11_hard_negatives, op12_prefix_trie,
                                   op13_jaccard_join)}

#: Brute force in DuckDB, where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": """
    WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label,
                 list_inner_product(a.e, v.e)::BIGINT AS score
          FROM v AS a JOIN v ON len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s
          WHERE label = anchor_label AND vec_id <> anchor_id
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE s.label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10""",
    "op12_prefix_trie": """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
                 xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
                         lambda d: ascii(d)::UBIGINT)),
                     lambda crc, d: list_reduce([xor(crc, d), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                         lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)),
                     4294967295::UBIGINT) % 6 AS h
          FROM conversations WHERE conv_id IS NOT NULL),
    r AS (SELECT c.conv_id, 0 AS half, idx, role, text FROM c JOIN t ON t.conv_id = c.base AND idx < h
          UNION ALL SELECT c.conv_id, 1, idx, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND idx >= h),
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY half, idx) AS depth FROM r),
    m AS (SELECT conv_id, depth, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM q
          UNION ALL SELECT conv_id, 0, '', [] FROM c),
    e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY 1),
    n AS (SELECT path, depth, min(m.conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(length(text)) AS size,
                 sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (last = depth), '')) AS ends_sha256
          FROM m JOIN e ON e.conv_id = m.conv_id GROUP BY 1, 2),
    k AS (SELECT p.path, count(*) AS kids, FROM n JOIN n AS p ON n.depth = p.depth + 1 AND n.path[1:p.depth] = p.path GROUP BY 1),
    b AS (SELECT p.path, sum((k.kids IS NULL)::INT)::BIGINT AS n_leaves, sum((d.n_convs - 1) * d.size)::BIGINT AS saved_tokens
          FROM n AS p JOIN n AS d ON d.depth >= p.depth AND d.path[1:p.depth] = p.path LEFT JOIN k ON k.path = d.path GROUP BY 1)
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids, 0)::BIGINT AS n_children,
           n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN b ON b.path = n.path LEFT JOIN k ON k.path = n.path
    LEFT JOIN n AS u ON u.depth = n.depth - 1 AND n.path[1:u.depth] = u.path""",
    "op13_jaccard_join": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
          ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS sh FROM w),
    u AS (SELECT doc_id, unnest(sh) AS g FROM s),
    n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * n_common >= 90 * (x.n_shingles + y.n_shingles - n_common)),
    r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
    SELECT doc_id, n_shingles, m.c AS component_id FROM n JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = doc_id"""}
