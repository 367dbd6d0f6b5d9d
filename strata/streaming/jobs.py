"""Structured Streaming jobs (STM1, STM2).

Both read a landing directory of Parquet files with a fixed schema, keep their progress in a
checkpoint under the shared folder and run with ``availableNow`` (process what is there,
then stop), so the same code serves a scheduled batch and a long-running stream. The
checkpoint belongs to the sink: the next run takes only new files and keeps the state. A micro-batch
takes files up to a number of bytes, so its tasks grow with the input, not its number of rounds.

STM1 ingest: each micro-batch is one batch of the store. A batch replayed after a failure replaces its
own partitions; documents whose source came with an earlier batch are left out before they are
chunked. No text is shuffled.

STM2 history: each micro-batch joins the messages of the version before with the new ones and writes the
last N of every conversation as the next version, by ``row_number``: no Python runs for a row. A
replayed batch starts from the same version and replaces its own. Versions that no replay can need are
deleted: what stays is the live one and its predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators import answer as A
from ..operators import chunk as CH
from ..operators import store as ST
from ..schemas import MESSAGE


BATCH_BYTES = 1 << 30  # of files that one micro-batch takes


def land(df: DataFrame, path: str) -> str:
    """Add a table to a landing folder as it is scanned: a file for each of its splits."""
    df.write.mode("append").parquet(path)
    return path


def checkpoint_of(sink: str) -> str:
    """The checkpoint beside a sink: a later run of the same sink goes on where the last ended."""
    return f"{sink.rstrip('/')}-checkpoint"


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def _files(spark: SparkSession, landing: str, schema: T.StructType, batch_bytes: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(landing)


def stream_ingest(spark: SparkSession, landing: str, schema: T.StructType, store_root: str,
                  max_chunk_size: int, overlap: int, batch_bytes: int = BATCH_BYTES) -> str:
    """STM1: documents (doc_id, text, source, ...) arriving as files -> chunks -> store."""
    CH.validate_chunk_params(max_chunk_size, overlap)

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        spark_, name = batch.sparkSession, f"stream-{epoch_id}"
        docs = batch.withColumn("source", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
        docs = ST.unseen(spark_, store_root, docs, name)
        c = CH.sentence_chunks(docs, "text", max_chunk_size, overlap, keep=("source",))
        ST.ingest(spark_, store_root, ST.chunk_rows(c), batch=name, check_sources=False)

    src = _files(spark, landing, schema, batch_bytes)
    _run(src.writeStream.foreachBatch(each_batch), checkpoint_of(store_root))
    return store_root


def stream_history(spark: SparkSession, landing: str, out: str, max_history: int = K.MAX_HISTORY,
                   batch_bytes: int = BATCH_BYTES) -> str:
    """STM2: messages arriving as files -> last ``max_history`` per conversation. Of messages with one
    conversation and turn the one that came last stays."""
    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        spark_ = batch.sparkSession
        old = ST.read_state(spark_, out, MESSAGE, before=epoch_id)
        both = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        latest = Window.partitionBy("conv_id", "turn").orderBy(F.desc("_new"))
        once = both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_new")
        ST.write_state(spark_, out, A.last_n(once, max_history), version=epoch_id)
        ST.drop_versions(spark_, out, epoch_id - 1)

    _run(_files(spark, landing, MESSAGE, batch_bytes).writeStream.foreachBatch(each_batch), checkpoint_of(out))
    return out


def latest_history(spark: SparkSession, out: str) -> DataFrame:
    """The live version of the STM2 output."""
    return ST.read_state(spark, out, MESSAGE)
