"""Extraction files to reports: Markdown per entry and bounded HTML pages per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import extract as X
from ..operators import report as R
from ..sources import files as SF


def write_reports(spark: SparkSession, jsonl_dir: str, out_dir: str, *, glob: str = K.EXTRACTION_GLOB,
                  partition_col: str = "source", per_page: int = 500) -> DataFrame:
    """Every envelope line becomes a report entry (a line that is not JSON becomes an
    'Error decoding' entry, not a failure); pages go to ``out_dir/<source>=.../``. Returns
    the entries."""
    raw = SF.read_extractions(spark, jsonl_dir, glob=glob, partition_col=partition_col)
    env = R.with_record(X.envelope_columns(raw))
    text = F.when(F.col("_corrupt").isNotNull(),
                  F.concat(F.lit("Error decoding JSON line: "), F.col("_corrupt"), F.lit("\n")))
    entries = env.select(partition_col, "source_file",
                         R.html_entry(F.coalesce(text, R.report_markdown(F.col("_v")))).alias("html"))
    return R.write_html_pages(entries, out_dir, group_col=partition_col, per_page=per_page)
