"""Question to evidence to answer, as one batch job over a table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import answer as A
from ..operators import encode as EN
from ..operators import knn


#: What a caller that has no instructions of its own tells the generator.
INSTRUCTIONS = ("Answer the question in a few sentences. Rely on the listed information alone, name the source of "
                "every statement, and say so if the information does not answer the question.")


@dataclass
class Answers:
    hits: DataFrame       # query_id, rank, id, similarity, content, source, embedding_type
    contexts: DataFrame   # query_id, context (questions with a relevant hit)
    prompts: DataFrame    # query_id, prompt (every question)
    answers: DataFrame    # query_id, has_context, answer (every question)


def answer_questions(questions: DataFrame, docs: DataFrame, vectors: DataFrame, *, k: int = K.ANSWER_TOP_K,
                     min_similarity: float = K.MIN_SIMILARITY, summary_type: str | None = None,
                     generated: DataFrame | None = None, encoder=None,
                     system_text: str = INSTRUCTIONS) -> Answers:
    """``questions``: query_id, query. ``docs``/``vectors``: the store tables. ``generated``
    (query_id, generated) is the caller's generator output; without it the best relevant
    hit's content stands in. Every question keeps a row in ``prompts`` and ``answers``."""
    q = EN.encode(questions, "query", "embedding", encoder=encoder)
    hits = knn.search(docs, vectors, q, k, summary_type=summary_type)
    ctx = A.context_blocks(hits, min_similarity)
    if generated is None:
        rel = hits.where(F.col("similarity") >= F.lit(min_similarity))
        generated = rel.groupBy("query_id").agg(F.min_by("content", "rank").alias("generated"))
    return Answers(hits, ctx, A.prompts(questions, ctx, system_text), A.finalize_answers(questions, ctx, generated))


def cited_answers(questions: DataFrame, docs: DataFrame, vectors: DataFrame, *, k: int = K.ANSWER_TOP_K,
                  encoder=None) -> DataFrame:
    """Extractive answers with citations from each question's top-k documents."""
    q = EN.encode(questions, "query", "embedding", encoder=encoder)
    hits = knn.search(docs, vectors, q, k)
    return A.cited_answers(questions, A.context_lines(hits))
