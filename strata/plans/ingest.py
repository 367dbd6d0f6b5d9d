"""Sources to store: extraction JSON lines or raw texts, validated, chunked or flattened,
encoded and appended idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..operators import chunk as CH
from ..operators import extract as X
from ..operators import store as ST
from ..sources import extraction_files as EF
from ..sources import files as SF


def ingest_extractions(spark: SparkSession, jsonl_dir: str, store_root: str, *, glob: str = K.EXTRACTION_GLOB,
                       encoder=None, batch: str = "0") -> DataFrame:
    """Scan extraction envelopes, split valid from quarantined lines, flatten findings,
    methods and relationships into typed store rows and ingest them. Returns the
    quarantined lines (bad JSON line or content) for inspection."""
    env = X.envelope_columns(SF.read_extractions(spark, jsonl_dir, glob=glob))
    ev = X.evidence_rows(X.with_paper(env.where("valid")))
    rows = ev.select("content", F.col("source_file").alias("source"), "embedding_type",
                     F.lit(K.DEFAULT_PROMPT).alias("prompt"), "ordinal")
    rows = rows.withColumn("id", ST.content_id("source", "embedding_type", "ordinal", "content")).drop("ordinal")
    ST.ingest(spark, store_root, rows, encoder=encoder, batch=batch)
    return env.where(~F.col("valid"))


def ingest_texts(spark: SparkSession, texts: DataFrame, store_root: str, *, text_col: str = "text",
                 source_col: str = "source", max_chunk_size: int = 1000, overlap: int = 0,
                 summary_type: str = K.DEFAULT_SUMMARY_TYPE, encoder=None, batch: str = "0") -> None:
    """Chunk texts (one source per row) and ingest the non-blank chunks."""
    c = CH.sentence_chunks(texts, text_col, max_chunk_size, overlap, keep=(F.col(source_col).alias("source"),))
    ST.ingest(spark, store_root, ST.chunk_rows(c, summary_type), encoder=encoder, batch=batch)


def ingest_pages(spark: SparkSession, pages: DataFrame, store_root: str, *, text_col: str = "text", source_col: str = "source",
                 page_col: str = "page_no", summary_type: str = K.DEFAULT_SUMMARY_TYPE, encoder=None, batch: str = "0") -> None:
    """Page texts (one row a page) that have enough words, each a chunk of its source."""
    c = CH.page_chunks(pages.select(F.col(source_col).alias("source"), F.col(page_col).alias("chunk_no"), text_col),
                       text_col, keep=("source", "chunk_no"))
    ST.ingest(spark, store_root, ST.chunk_rows(c.withColumnRenamed("text", "chunk"), summary_type), encoder=encoder, batch=batch)


def ingest_raw_lines(spark: SparkSession, path: str, store_root: str, *, glob: str = K.EXTRACTION_GLOB,
                     summary_type: str = K.DEFAULT_SUMMARY_TYPE, encoder=None, batch: str = "0") -> None:
    """Every non-blank line of the matching files, stripped, with its file as the source. A line that a
    file repeats is stored once for each of its places."""
    lines = EF.read_lines(spark, path, glob).select(F.col("file_name").alias("source"), F.col("line_no").alias("chunk_no"),
                                                    TX.ustrip("line").alias("chunk"))
    ST.ingest(spark, store_root, ST.chunk_rows(lines, summary_type), encoder=encoder, batch=batch)
