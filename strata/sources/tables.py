"""Table access and the store views built on the given tables.

Parquet reads keep their file schema; Catalyst prunes columns and pushes filters into the
scan, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.encode import DEFAULT_DIM, hashed_bow

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Session setting: partitions to which the scan of a given table is dealt out. Unset (as on a cluster,
#: where tables have many splits) scans stay as they are; a local session whose tables are single row
#: groups sets it to its number of cores.
SCAN_PARTITIONS = "strata.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents store over the given ``documents`` table: ``lang`` plays the evidence
    type, the prompt is the ingest default."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source",
                    F.col("lang").alias("embedding_type"), F.lit(K.DEFAULT_PROMPT).alias("prompt"))


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors store over the given ``embeddings`` table (vec_id = document id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def benchmark_queries(spark: SparkSession, sf_dir: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Every benchmark item is a question; its vector comes from the same encoder."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                    hashed_bow("text", dim).alias("embedding"))
