"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised in their scan tasks, and the pieces (id, start, length, token ids) written once.
A piece's rank, longest first, is known without moving it: the number of longer pieces, of pieces of
its length in the tasks before, and of those before it in its own task. Only counts for each task and
length are shuffled; token ids never are. The plan is best fit decreasing over the histogram of
lengths, a sequential loop on the driver: the pieces of one length go to the smallest gap that
holds them, and open new sequences where there is none. It replaces distributed sweeps over
range-sorted gaps with conflicts resolved by rank; no such sweeps run on Spark.

Pieces of one length are a run of ranks, and sequences with one gap are a run of numbers, so
the loop matches runs, not rows: the plan is at most a few runs for each of the ``limit``
lengths, whatever the number of documents. The histogram of lengths (``limit`` rows at most) is
all that reaches the driver; every piece then finds its run by binary search in its own task.
No group of pieces is ever gathered.

Defined results: a null or empty text is one piece of the end token alone; repeated rows are
packed as they come; an empty table gives an empty result; a null doc_id is kept as null;
other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import list_files, scratch_path

from .common import arrow_batches, staged

LIMIT = 4096
END = 1
_PIECE = "doc_id long, piece int, start long, length long, ids binary"
_CUT = f"{_PIECE}, part int, nth long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary())])
_CUT_SCHEMA = pa.schema([*_SCHEMA, ("part", pa.int32()), ("nth", pa.int64())])


def pieces(documents: DataFrame, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The pieces of every document: ids (32 bits each, little-endian), then ``end``, cut every ``limit``
    tokens; ``nth`` numbers the pieces of one length within a task (``part``)."""
    arrow_batches(documents.sparkSession)

    def cut(batches):
        from pyspark import TaskContext

        from .tokenize import encoder
        encode = encoder().encode
        part, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        tail = np.array([end], np.uint32).tobytes()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                raw = ids.tobytes() + tail
                for k, at in enumerate(range(0, len(raw), 4 * limit)):
                    own = raw[at:at + 4 * limit]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, own, part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_SCHEMA)],
                                                 schema=_CUT_SCHEMA)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _CUT)


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (rank, pieces, length, first sequence, pieces to a sequence, offset) for pieces of
    the given lengths, ranked longest first.

    Best fit decreasing: a sequence that takes a piece and still has the smallest gap that
    holds the next one of that length takes it too."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    sizes: list[int] = []  # gaps in size order
    runs, rank, opened = [], 0, 0

    def put(gap, first, number):
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor gap
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, number = limit, opened, left
                opened += -(-left // (limit // length))
            per = gap // length
            full, rest = divmod(left, per)
            if full >= number:
                full, rest = number, 0
            if full:
                runs.append((rank, full * per, length, first, per, limit - gap))
                put(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if rest:
                runs.append((rank, rest, length, first + full, rest, limit - gap))
                put(gap - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
                full += 1
            if gap < limit:
                put(gap, first + full, number - full)
    return runs


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cut`` (of :func:`pieces`) with sequence_id and offset."""
    cut = staged(cut, "packing-pieces")
    spark = cut.sparkSession
    own = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    folder = scratch_path(spark, "packing-before")  # a small file for each task of the cut
    (own.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
     .repartition("part").write.partitionBy("part").parquet(folder))
    first, longer = np.zeros(limit + 1, np.int64), 0
    for length in sorted(counts, reverse=True):
        first[length], longer = longer, longer + counts[length]
    runs = np.array(plan(counts, limit), np.int64).reshape(-1, 6)
    schema = pa.schema([*_SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        import pyarrow.parquet as pq
        rank0, _, length, sequence, per, offset = runs.T

        @lru_cache(maxsize=4)
        def before(part):  # the ranks of a task's first piece of each length
            files, names = list_files(f"{folder}/part={part}", ".parquet")
            out = first.copy()
            for name in names:
                with files.open_input_file(name) as f:
                    t = pq.ParquetFile(f).read()
                out[t.column("length").to_numpy()] += t.column("before").to_numpy()
            return out
        for b in batches:
            size, part = (b.column(c).to_numpy() for c in ("length", "part"))
            rank = b.column("nth").to_numpy().copy()
            for p in np.unique(part).tolist():
                own = part == p
                rank[own] += before(p)[size[own]]
            k = np.searchsorted(rank0, rank, "right") - 1
            nth = rank - rank0[k]
            columns = [b.column(f.name) for f in _SCHEMA]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[k] + nth // per[k]), pa.array(offset[k] + nth % per[k] * length[k])],
                schema=schema)
    return cut.mapInArrow(place, f"{_PIECE}, sequence_id long, offset long")


def packed_ids(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every document's pieces with their token ids, sequence and place."""
    return pack(pieces(documents, limit), limit)


def packed(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every document's pieces with the checksum of their ids, their sequence and place."""
    return packed_ids(documents, limit).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                               "sequence_id", "offset")
