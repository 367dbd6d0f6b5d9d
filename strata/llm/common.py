"""Shared helpers of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

#: One or more of the six ASCII blanks that end a word (Java regex).
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows per Arrow batch: document texts are long, so 10,000 of them would not be bounded well.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole documents small (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS):
    """Small Arrow batches for the jobs that run within; the session's setting is as before after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Shuffle files of a query that runs within are removed when it is done; the session's setting is as before
    after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table cuts the lineage: a lost executor re-reads it instead of repeating the steps
    above, and values that depend on the physical layout (range bounds, row numbers within a
    partition) are fixed once written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each stem (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        n = f"_{s}"
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def exprs_sum(values: Column) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, whatever the number of its uses in ``f``."""
    return F.element_at(F.transform(F.array(value), f), 1)
