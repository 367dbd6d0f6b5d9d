"""The document store and small state tables (SNK1, SNK3, SNK4, SRC5-SRC7, JOI3, JOI6).

Store = three Parquet tables under one root:

* ``documents/batch=<b>`` (id, content, source, embedding_type, prompt),
* ``embeddings/embedding_type=<t>/batch=<b>`` (id, source, embedding): a search for one type reads
  the directories of that type alone,
* ``sources/batch=<b>`` (source): what a batch has brought in, written last.

A batch is written by dynamic partition overwrite: it replaces its own partitions and no others, so
a batch that runs again (a retried job, a replayed micro-batch, a run that died between two
tables) leaves one copy of everything. Vectors are encoded from the documents as written, so
every vector has its document. Rows whose source came with another batch are left out by a join on the
source names of the batch, which are broadcast after a check of their size. Neither texts nor vectors
are shuffled.

State tables (progress, chat history) are versioned directories ``<root>/v=<n>``: a new
version is written in full, then becomes visible by being the highest complete version
(``_SUCCESS`` present). Readers never see a half-written state and no rename is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..schemas import PROGRESS, STORE_DOCUMENTS, STORE_SOURCES, VECTOR_TABLE
from ..session import scratch_path, shared_dir
from . import encode as EN
from .answer import last_n

ID_SEP = "\u001f"
ID_NULL = "\u0000"


def content_id(*cols) -> Column:
    """Deterministic id: SHA-256 of the identifying fields; a NULL field has a mark of its own."""
    fields = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat_ws(ID_SEP, *[F.coalesce(c.cast("string"), F.lit(ID_NULL)) for c in fields]), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC5: a store table with its fixed schema, or an empty one when absent."""
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    return spark.createDataFrame([], schema)


#: Bytes of source names that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 64 << 20


def read_vectors(spark: SparkSession, root: str, embedding_type: str | None = None) -> DataFrame:
    """The vectors (id, source, embedding, embedding_type) of a store; those of one type are read from
    its own directories."""
    v = read_table(spark, f"{root}/embeddings", VECTOR_TABLE)
    return v.where(F.col("embedding_type") == embedding_type) if embedding_type else v


def unseen(spark: SparkSession, root: str, rows: DataFrame, batch: str, source_col: str = "source") -> DataFrame:
    """``rows`` without those whose source another batch has brought into the store."""
    path = f"{root}/sources"
    if not _exists(spark, path):
        return rows
    schema = STORE_SOURCES.add("batch", "string")
    others = spark.read.schema(schema).parquet(path).where(F.col("batch") != batch).select(F.col("source").alias("_seen"))
    names = rows.select(F.col(source_col).alias("_seen")).distinct()
    shared_dir(spark)
    seen = names.join(others, "_seen", "left_semi").checkpoint()
    size = seen.agg(F.sum(F.octet_length("_seen"))).first()[0]
    if size is None:
        return rows
    return rows.join(F.broadcast(seen) if size <= MAX_BROADCAST else seen, F.col(source_col) == F.col("_seen"), "left_anti")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` by partitions: those that it has rows for are replaced, at the job's commit. Most of a store
    of short chunks are ids in hexadecimal, which zstd halves and snappy does not."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*by).parquet(path))


def ingest(spark: SparkSession, root: str, rows: DataFrame, encoder=None, batch: str = "0",
           check_sources: bool = True) -> None:
    """SNK1: add ``rows`` (id, content, source, embedding_type, prompt) and their vectors as ``batch``.

    Blank contents are dropped, and of rows with one id one stays. ``check_sources=False`` is for
    callers that have left out known sources before they cut their texts (:func:`unseen`)."""
    names = STORE_DOCUMENTS.names
    if check_sources:
        rows = unseen(spark, root, rows, batch)
    rows = rows.where(F.col("content").isNotNull() & ~TX.is_blank("content")).select(*names)
    own = F.lit(batch).alias("batch")
    _replace(rows.select(*names, own), f"{root}/documents", "batch")
    path = f"{root}/documents/batch={batch}"
    written = read_table(spark, path, STORE_DOCUMENTS)
    # by hash: should two ids share one, the rows are reduced by id below, and none is lost
    ids = written.agg(F.count("id").alias("n"), F.count_distinct(F.xxhash64("id")).alias("distinct")).first()
    if ids["n"] != ids["distinct"]:
        once = scratch_path(spark, "store-once")
        written.dropDuplicates(["id"]).write.parquet(once)
        _replace(spark.read.schema(STORE_DOCUMENTS).parquet(once).select("*", own), f"{root}/documents", "batch")
        written = read_table(spark, path, STORE_DOCUMENTS)
    col = encoder(F.col("content")) if encoder is not None else EN.hashed_bow("content")
    vectors = written.select("id", "source", col.cast("array<double>").alias("embedding"), "embedding_type", own)
    _replace(vectors, f"{root}/embeddings", "embedding_type", "batch")
    _replace(written.select("source").distinct().select("source", own), f"{root}/sources", "batch")


def chunk_rows(chunks: DataFrame, summary_type: str = K.DEFAULT_SUMMARY_TYPE, prompt: str = K.DEFAULT_PROMPT) -> DataFrame:
    """Chunks (source, chunk_no, chunk) as store rows with deterministic ids."""
    r = chunks.select(F.col("chunk").alias("content"), "source", F.lit(summary_type).alias("embedding_type"),
                      F.lit(prompt).alias("prompt"), "chunk_no")
    return r.withColumn("id", content_id("source", "embedding_type", "prompt", "chunk_no", "content"))


# ---- versioned state tables ---------------------------------------------------------------

def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_state(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    """The highest complete version (below ``before``), or an empty table."""
    v = [x for x in _versions(spark, root) if before is None or x < before]
    if not v:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={v[-1]}")


def write_state(spark: SparkSession, root: str, df: DataFrame, version: int | None = None) -> int:
    """Write the next version; a second writer of it fails. A given ``version`` is that of a replayable
    batch, which replaces what an attempt before has written."""
    v = _versions(spark, root)
    nxt = version if version is not None else v[-1] + 1 if v else 1
    df.write.mode("error" if version is None else "overwrite").parquet(f"{root}/v={nxt}")
    return nxt


def drop_versions(spark: SparkSession, root: str, below: int) -> None:
    """Delete the versions of a state table below ``below``, but never the highest one."""
    fs, p = _fs(spark, root)
    for v in _versions(spark, root)[:-1]:
        if v < below:
            fs.delete(p.suffix(f"/v={v}"), True)


def read_progress(spark: SparkSession, root: str | None) -> DataFrame:
    """SRC6: (source, chunks_processed); no path or no state gives an empty table."""
    if not root:
        return spark.createDataFrame([], PROGRESS)
    return read_state(spark, root, PROGRESS)


def upsert_progress(spark: SparkSession, root: str | None, updates: DataFrame) -> int | None:
    """SNK3: last write wins per source; a no-op without a path. Within one update, which has
    no order, the most advanced count of a source is its last write."""
    if not root:
        return None
    old = read_progress(spark, root)
    new = updates.groupBy("source").agg(F.max(F.col("chunks_processed").cast("long")).alias("chunks_processed"))
    return write_state(spark, root, old.join(new.select("source"), "source", "left_anti").unionByName(new))


def pending(sources: DataFrame, done: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """JOI3: sources without output yet; ``retry_failed`` redoes everything."""
    if retry_failed:
        return sources
    return sources.join(done.select(key).distinct(), key, "left_anti")


def append_history(spark: SparkSession, root: str, messages: DataFrame, schema,
                   max_history: int = K.MAX_HISTORY) -> int:
    """SNK4: append messages and keep the last ``max_history`` per conversation."""
    cur = read_state(spark, root, schema)
    return write_state(spark, root, last_n(cur.unionByName(messages.select(*cur.columns)), max_history))


def clear_history(spark: SparkSession, root: str, schema) -> int:
    return write_state(spark, root, spark.createDataFrame([], schema))
