"""Streaming queries (STM1, STM2): the given tables land as files and are consumed by the
Structured Streaming jobs; the query returns the sink table they produced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as ST
from ..schemas import MESSAGE, STORE_DOCUMENTS
from ..session import scratch_path
from ..streaming import jobs as SJ
from ._registry import query
from .answers import LAST_N
from .storage import _INGEST_SQL
from .text import MAX_CHUNK, OVERLAP


@query("stream_ingest", sql=_INGEST_SQL)
def stream_ingest(spark, sf):
    """STM1: documents arriving as files, chunked and ingested into the store in two runs of the
    stream: half of them land before the first run, the others (and again some of the first) before the
    second, which takes only the new files and leaves out known sources."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    landing, root = scratch_path(spark, "landing-docs"), scratch_path(spark, "stream-store")
    early = F.col("doc_id") % 2 == 0
    for part in (d.where(early), d.where(~early | (F.col("doc_id") % 4 == 0))):
        SJ.land(part, landing)
        SJ.stream_ingest(spark, landing, d.schema, root, MAX_CHUNK, OVERLAP)
    return ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)


@query("stream_history", sql=f"""
    SELECT conv_id, turn, role, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    WHERE rn <= {LAST_N}""")
def stream_history(spark, sf):
    """STM2: messages arriving as files in any order, in two runs of the stream (odd turns before even
    ones); the state keeps the last 3 by turn of every conversation."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(*MESSAGE.names)
    landing, out = scratch_path(spark, "landing-msgs"), scratch_path(spark, "history-out")
    odd = F.coalesce(F.col("turn") % 2 != 0, F.lit(False))
    for part in (c.where(odd), c.where(~odd)):
        SJ.land(part, landing)
        SJ.stream_history(spark, landing, out, LAST_N)
    return SJ.latest_history(spark, out)
