"""Training-order materialisation as fixed-stride binary shards.

Every token sequence gets a running number (its partition's offset plus its place there) and a
global slot: a keyed Feistel permutation of the smallest even number of bits that holds the
count, walked along its cycle until the result is below the count. So the training order is a
seeded shuffle of all sequences that needs no sort of random keys, and any slot's number can be
computed alone. Sequences are partitioned by shard and written in slot order: a shard is a
run of slots, one record of fixed stride each, so slot s is in shard s // per_shard at byte
(s % per_shard) * stride, reads are sequential, and a reader resumes at any slot. The shards are
written in a few passes over the staged sequences, each of which shuffles those of its own run of
shards; Spark removes a pass's shuffle files when it is done, so no more than one pass's lie on disk.

A record is doc_id (int64), piece (int32), length (int32) and ``seq_len`` token ids (uint16,
zero after ``length``), all little endian. A null doc_id is
written as the smallest int64. A shard is written under a name of its own attempt and then
renamed, so a retried or speculative task replaces whole files only.

Defined results: a null or empty text is one sequence of the end token; repeated rows are
sequences of their own; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

from .common import arrow_batches, shuffle_files_removed, staged
from .packing import END

SEQ_LEN = 512
PER_SHARD = 16384
ROUNDS = 6
PASSES = 3
HEADER = 16
NULL_ID = -(1 << 63)


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of ``numbers``: a keyed permutation of 0 .. count - 1."""
    bits = max(2, (max(1, count - 1)).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    x = numbers.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():  # cycle walking
        v = x[todo]
        left, right = v >> half, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, r) & mask)
        x[todo] = left << half | right
        todo[todo] = x[todo] >= count
    return x.astype(np.int64)


_SEQ = "doc_id long, piece int, ids binary"
_SEQ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])


def sequences(documents: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Token sequences of at most ``seq_len`` ids (uint16) of every document and its end."""
    arrow_batches(documents.sparkSession)

    def cut(batches):
        from .tokenize import encoder
        encode, tail = encoder().encode, np.array([END], np.uint32)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                ids = np.concatenate([ids, tail]).astype("<u2")
                rows += [(doc_id, k, ids[at:at + seq_len].tobytes())
                         for k, at in enumerate(range(0, len(ids), seq_len))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEQ_SCHEMA)],
                                                 schema=_SEQ_SCHEMA)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _SEQ)


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def materialise(documents: DataFrame, folder: str, key: int = 20240229, seq_len: int = SEQ_LEN,
                per_shard: int = PER_SHARD) -> DataFrame:
    """Write all sequences to ``folder`` (a shared folder); the manifest: shard, slots, bytes."""
    spark = documents.sparkSession
    rows = staged(sequences(documents, seq_len).withColumn("at", F.monotonically_increasing_id()), "order-sequences")
    sizes = dict(rows.groupBy(F.shiftright("at", 33)).agg(F.count(F.lit(1))).collect())
    count, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p], count = count, count + sizes[p]

    @F.pandas_udf("long")
    def slots(at):
        at = at.to_numpy()
        base = np.array([offsets[p] for p in (at >> 33).tolist()], np.int64)
        return _series(permute(base + (at & ((1 << 33) - 1)), count, key))

    def write(batches):
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        shard = out = None
        n = 0

        def close():
            out.close()
            files.move(attempt, f"{root}/shard-{shard:08d}.bin")
            return pa.RecordBatch.from_pydict({"shard": [shard], "slots": [n], "bytes": [n * (HEADER + 2 * seq_len)]},
                                              schema=_MANIFEST)
        for b in batches:
            for s, d, piece, ids in zip(*(b.column(c).to_pylist() for c in ("slot", "doc_id", "piece", "ids"))):
                if s // per_shard != shard:
                    if out is not None:
                        yield close()
                    shard, n = s // per_shard, 0
                    attempt = f"{root}/_{shard:08d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(attempt)
                if s % per_shard != n:
                    raise RuntimeError("a slot is missing")
                head = np.array([NULL_ID if d is None else d, piece | len(ids) // 2 << 32], "<i8").tobytes()
                out.write(head + ids.ljust(2 * seq_len, b"\0"))
                n += 1
        if out is not None:
            yield close()
    slot = slots.asNondeterministic()  # else the filter on its result would compute it once more
    ordered = rows.withColumn("slot", slot("at")).withColumn("shard", F.expr(f"slot div {per_shard}"))
    shards = max(1, -(-count // per_shard))
    run = -(-shards // PASSES)
    manifest = []
    with shuffle_files_removed(spark):
        for first in range(0, shards, run):
            last = min(first + run, shards)
            own = ordered.where(F.col("shard").between(first, last - 1)) if run < shards else ordered
            own = own.repartitionById(last - first, F.expr(f"cast(shard - {first} as int)")).sortWithinPartitions("slot")
            manifest.append(staged(own.select("slot", "doc_id", "piece", "ids").mapInArrow(write, _WRITTEN), "order-manifest"))
    return reduce(DataFrame.unionAll, manifest)


_WRITTEN = "shard long, slots long, bytes long"
_MANIFEST = pa.schema([("shard", pa.int64()), ("slots", pa.int64()), ("bytes", pa.int64())])


def _series(x):
    import pandas as pd
    return pd.Series(x)


_READ = "slot long, doc_id long, piece int, length int, ids_crc32 long"
_READ_SCHEMA = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int32()),
                          ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, folder: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD,
                start: int = 0) -> DataFrame:
    """One row for each record of the shards in ``folder``: slot, doc_id, piece, length, and
    the checksum of its ids as little-endian uint16.

    ``start`` resumes a training run: records from that slot on; shards before it are not opened."""
    stride = HEADER + 2 * seq_len

    def parse(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                data = data.as_buffer()
                shard = int(path.rsplit("shard-", 1)[1].split(".")[0])
                rec = np.frombuffer(data, np.uint8).reshape(-1, stride)
                head = rec[:, :HEADER].copy().view("<i8")
                length = head[:, 1] >> 32
                crc = [zlib.crc32(rec[i, HEADER:HEADER + 2 * n].tobytes()) for i, n in enumerate(length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(rec)) + shard * per_shard),
                    pa.array(head[:, 0], mask=head[:, 0] == NULL_ID), pa.array((head[:, 1] & 0xFFFFFFFF).astype(np.int32)),
                    pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())], schema=_READ_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    if start:
        number = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
        wanted = [r[0] for r in files.select("path").where(number >= start // per_shard).collect()]  # names of files alone
        if not wanted:
            return spark.createDataFrame([], _READ)
        files = spark.read.format("binaryFile").load(wanted)
    rows = files.select("path", "content").mapInArrow(parse, _READ)
    return rows.where(F.col("slot") >= start) if start else rows


def training_order(documents: DataFrame) -> DataFrame:
    """Write the shards of all documents under the shared folder and read them back."""
    spark = documents.sparkSession
    folder = scratch_path(spark, "training-order")
    manifest = materialise(documents, folder)
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], _READ)
    return read_shards(spark, folder)
