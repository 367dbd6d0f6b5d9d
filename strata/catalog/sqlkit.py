"""DuckDB SQL fragments shared by the oracles (they re-derive, in plain SQL, what the Spark
queries compute). Whitespace classes: the test text holds only space and LF as whitespace,
so RE2's ASCII ``\\s`` suffices there; word classes are spelled ``[\\p{L}\\p{N}_]``."""

from __future__ import annotations

DIM = 64


def bow(table: str, id_expr: str, text_expr: str, dim: int = DIM) -> str:
    """Hashed bag of words as (id, bucket, cnt) rows."""
    return f"""(SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim})::INTEGER AS bucket,
               count(*)::BIGINT AS cnt
        FROM (SELECT {id_expr} AS id,
                     unnest(regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}_]+')) AS tok
              FROM {table}) GROUP BY 1, 2)"""


def bow_knn(k: int, q_table: str = "benchmark", q_id: str = "item_id", q_text: str = "text",
            d_filter: str = "TRUE", d_table: str = "documents", d_id: str = "doc_id", d_text: str = "text") -> str:
    """Exact top-k by cosine of hashed bags of words: every query against every document
    (brute force is fine for an oracle), ties by ascending doc id."""
    return f"""
    qv AS {bow(q_table, q_id, q_text)},
    dv AS {bow(f"(SELECT * FROM {d_table} WHERE {d_filter})", d_id, d_text)},
    qn AS (SELECT id, sum(cnt * cnt) AS n2 FROM qv GROUP BY id),
    dn AS (SELECT id, sum(cnt * cnt) AS n2 FROM dv GROUP BY id),
    dots AS (SELECT qv.id AS qid, dv.id AS did, sum(qv.cnt * dv.cnt) AS dot
             FROM qv JOIN dv ON qv.bucket = dv.bucket GROUP BY 1, 2),
    sims AS (SELECT qn.id AS query_id, dn.id AS id,
                    coalesce(dots.dot, 0)::DOUBLE / sqrt((qn.n2 * dn.n2)::DOUBLE) AS similarity
             FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.qid = qn.id AND dots.did = dn.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
               FROM sims),
    hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


# Python str.strip() / split() on text whose whitespace is space and LF
def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def word_count(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '\\S+'))"


SENTENCE_RE = "[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$"


def sentences(expr: str) -> str:
    """Sentence pieces, stripped, empties dropped (same rule as the Spark chunker)."""
    return (f"list_filter(list_transform(regexp_extract_all({expr}, '{SENTENCE_RE}'), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")
