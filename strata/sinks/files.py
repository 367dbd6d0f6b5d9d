"""File sinks (SNK2, SNK5, raw text). Writers are plain DataFrame writes: one directory per
source value (``partitionBy``), so every task writes its own files and nothing is gathered
on the driver. Paths come from the caller (the shared folder on a cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines_by(df: DataFrame, path: str, line_col: str, by: str, mode: str = "overwrite") -> str:
    """Write ``line_col`` as text lines, one directory ``<by>=<value>`` per value."""
    df.select(F.col(line_col).alias("value"), by).write.mode(mode).partitionBy(by).text(path)
    return path


def write_extraction_jsonl(envelopes: DataFrame, path: str, source_col: str = "source") -> str:
    """SNK2: envelope lines grouped into one JSON-lines directory per source."""
    return write_lines_by(envelopes, path, "line", source_col)
