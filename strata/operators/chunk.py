"""Text chunking (CHK1) and page chunks (FLT1, FLT2), all as native expressions.

Each text is cut inside its own row (regex split, array higher-order functions, then one
``posexplode``): no shuffle, no Python, and a long text never leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX


def validate_chunk_params(max_chunk_size: int, overlap: int) -> None:
    """Parameter rules of the chunker, checked eagerly on the driver."""
    if max_chunk_size <= 0:
        raise ValueError("max_chunk_size must be positive")
    if overlap < 0:
        raise ValueError("overlap must be non-negative")
    if overlap >= max_chunk_size:
        raise ValueError("overlap must be less than max_chunk_size")


def chunk_array(text_col, max_chunk_size: int) -> Column:
    """Sentences (cut after . ! ? or newline, stripped, empties dropped); a sentence longer
    than ``max_chunk_size`` characters is sliced every ``max_chunk_size`` characters and each
    slice stripped (a slice of only spaces yields an empty chunk). Sentences are never
    merged. NULL or empty text gives an empty array."""
    m = int(max_chunk_size)

    def pieces(s):
        n = F.length(s)
        slices = F.transform(F.sequence(F.lit(0), n - 1, F.lit(m)),
                             lambda i: TX.ustrip(F.substring(s, i + 1, m)))
        return F.when(n > m, slices).otherwise(F.array(s))

    sents = TX.sentences(F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")))
    return F.flatten(F.transform(sents, pieces))


def sentence_chunks(df: DataFrame, text_col: str, max_chunk_size: int = 1000, overlap: int = 0,
                    keep: tuple = ()) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``chunk_no`` (0-based), ``chunk``.

    ``overlap`` is validated and has no effect, as in the behaviour being reproduced.
    """
    validate_chunk_params(max_chunk_size, overlap)
    return df.select(*keep, F.posexplode(chunk_array(text_col, max_chunk_size)).alias("chunk_no", "chunk"))


def page_chunks(df: DataFrame, text_col: str, keep: tuple = (), min_words: int = K.PAGE_MIN_WORDS) -> DataFrame:
    """Keep a page text iff, stripped, it has more than ``min_words`` whitespace words."""
    t = TX.ustrip(F.col(text_col))
    return (df.select(*keep, t.alias("text"))
              .withColumn("n_words", TX.word_count("text"))
              .where(F.col("n_words") > F.lit(min_words)))
