"""File sources (SRC1-SRC4): extraction JSONL directories, raw text lines, source-file
listings and the size gate. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import jsonx as J
from ..functions import text as TX
from ..schemas import ENVELOPE
from . import extraction_files as EF


def read_extractions(spark: SparkSession, path: str, glob: str = K.EXTRACTION_GLOB,
                     partition_col: str | None = None) -> DataFrame:
    """SRC1: every envelope line of the matching files under ``path``.

    A line that is not one JSON value from end to end lands in ``_corrupt`` (one bad line does
    not stop its file or the job); ``partition_col`` names a directory partition to keep as a
    column."""
    extra = [T.StructField(partition_col, T.StringType())] if partition_col else []
    lines = (spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *extra]))
             .option("pathGlobFilter", glob).text(path).where(F.trim("value") != ""))
    return parse_envelope_lines(lines, "value", [f.name for f in extra])


def read_extraction_files(spark: SparkSession, path: str, glob: str = K.EXTRACTION_GLOB) -> DataFrame:
    """SRC1 by file: as :func:`read_extractions`, with the file name and line number of every line."""
    return parse_envelope_lines(EF.read_lines(spark, path, glob), "line", ["file_name", "line_no"])


def parse_envelope_lines(lines: DataFrame, line_col: str, keep: list[str]) -> DataFrame:
    """Envelope columns of each line, ``_corrupt`` for one that is not JSON, and the columns to keep."""
    fields = [f for f in ENVELOPE.fields if f.name != "_corrupt"]
    lines = lines.select(F.col(line_col).alias("_line"), TX.once(J.is_valid_json(line_col)).alias("_ok"), *keep)
    lines = lines.select(TX.once(F.when(F.col("_ok"), F.from_json("_line", T.StructType(fields)))).alias("env"),
                         F.when(~F.col("_ok"), F.col("_line")).alias("_corrupt"), *keep)
    return lines.select(*[F.col(f"env.{f.name}") if f.name != "_corrupt" else F.col("_corrupt")
                          for f in ENVELOPE.fields], *keep)


def read_raw_lines(spark: SparkSession, path: str, glob: str = "*", partition_col: str | None = None) -> DataFrame:
    """SRC2/FLT2: every non-blank line, stripped, with the file it came from."""
    schema = T.StructType([T.StructField("value", T.StringType())]
                          + ([T.StructField(partition_col, T.StringType())] if partition_col else []))
    df = spark.read.schema(schema).option("pathGlobFilter", glob).text(path)
    cols = [TX.ustrip("value").alias("content"), F.col("_metadata.file_name").alias("file_name")]
    if partition_col:
        cols.append(F.col(partition_col))
    return df.select(*cols).where(F.col("content") != "")


def list_files(spark: SparkSession, path: str, glob: str = K.SOURCE_GLOB) -> DataFrame:
    """SRC3: (path, name, length) of the files directly under ``path`` matching ``glob``.
    Only metadata columns are selected, so file contents are never read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    return df.select("path", TX.basename("path").alias("name"), "length")


def size_gate(length_col: str = "length"):
    """SRC4: (valid, reason) of a file size: 0.001 MB <= size <= 100 MB."""
    n = F.col(length_col)
    reason = (F.when(n.isNull(), F.lit("missing"))
               .when(n > F.lit(K.MAX_FILE_BYTES), F.lit("too_large"))
               .when(n < F.lit(K.MIN_FILE_BYTES), F.lit("too_small")))
    return reason.isNull().alias("valid"), reason.alias("reason")
