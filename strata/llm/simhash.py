"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes of shingle hashes. Distinct fingerprints are range
sorted by Gray rank, so neighbours share most bits, and cut into blocks. Within a block an
index is built bottom-up: a leaf group of :data:`FAN` neighbours factors out the bits they all
share (a mask and a pattern), and each upper node factors out the bits its children share, so a
child stores only what its parent does not. A search adds up the differences on the way down
and drops a whole group as soon as its sum exceeds the distance. The roots of the blocks prune
pairs of blocks in the same way, so a block meets only the few blocks near it; pairs of blocks
are ordinary rows that Spark shuffles.

A block pair returns only a spanning forest of its links, and the components of all forests
are found by rounds of smallest-label exchange with pointer jumping, each written to the shared
folder. No fingerprint list is collected: the driver sees one mask and pattern for each block,
at most :data:`MAX_BLOCKS` of them (blocks grow beyond that).

Defined results: a null or empty text has no words, fingerprint zero, and is linked like any
other; rows with one fingerprint are one component; a null doc_id is never the smallest unless
all ids of the component are null (the component is null then); repeated rows are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import LOWER, arrow_batches, fresh, staged

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCK = 16384
MAX_BLOCKS = 1 << 18
FAN = 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8) as an unsigned 64-bit integer."""
    import xxhash
    ws = (text or b"").translate(LOWER).split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = ends - np.fromiter(map(len, ws), np.int64, len(ws)) - 1
    k = min(shingle, len(ws))
    n = len(ws) - k + 1
    a, b = starts[:n].tolist(), (ends[k - 1:] - 1).tolist()
    votes = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        h = np.array([h64(line[x:y], SEED) for x, y in zip(a[at:at + (1 << 16)], b[at:at + (1 << 16)])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((votes * 2 > n), bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int):
    @pandas_udf("long")
    def f(text: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, shingle) for t in text), np.uint64, len(text))
        return pd.Series(out.view(np.int64))
    return f


def gray_rank(fp):
    """The position of a fingerprint in Gray order (inverse Gray code), as a column."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _levels(f: np.ndarray):
    """Node levels of sorted fingerprints, leaf groups first: (mask, pattern) for each node."""
    both, some = f, f
    out = []
    while True:
        at = np.arange(0, len(both), FAN)
        both, some = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(some, at)
        mask = ~(both ^ some)
        out.append((mask, both & mask))
        if len(at) <= FAN:
            return out


def _search(queries: np.ndarray, f: np.ndarray, most: int, step: int = 2048):
    """Pairs (query index, fingerprint index) within ``most`` bits, in bounded pieces."""
    levels = _levels(f)
    sizes = [len(f)] + [len(m) for m, _ in levels]
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        top = len(levels[-1][0])
        qi, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        acc = np.zeros(len(qi), np.uint8)
        parent_mask = np.zeros(len(qi), np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[depth]
            own = mask[node] & ~parent_mask  # bits that the parent has not counted
            acc = acc + np.bitwise_count((q[qi] ^ pattern[node]) & own)
            ok = acc <= most
            qi, node, acc = qi[ok], node[ok], acc[ok]
            parent_mask = mask[node]
            below = sizes[depth]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            qi, acc, parent_mask = np.repeat(qi, FAN), np.repeat(acc, FAN), np.repeat(parent_mask, FAN)
            ok = child < below
            qi, node, acc, parent_mask = qi[ok], child[ok], acc[ok], parent_mask[ok]
        ok = acc + np.bitwise_count((q[qi] ^ f[node]) & ~parent_mask) <= most
        yield qi[ok] + at, node[ok]


class _Forest:
    """Components of a growing set of links between n items; roots are smallest items."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while len(a):
            ra, rb = up[a], up[b]
            low = np.minimum(ra, rb)
            np.minimum.at(up, np.maximum(ra, rb), low)
            while True:  # pointer jumping
                nxt = up[up]
                if np.array_equal(nxt, up):
                    break
                up = nxt
            ok = up[a] != up[b]
            a, b = a[ok], b[ok]
        self.up = up


def _pack(batches):
    """Partition of sorted fingerprints -> rows (block, mask, pattern, fps) of bounded size."""
    from pyspark import TaskContext
    base, seq = TaskContext.get().partitionId() << 20, 0
    held = np.zeros(0, np.uint64)

    def row(f):
        mask = ~(np.bitwise_and.reduce(f) ^ np.bitwise_or.reduce(f))
        m, p = np.array([mask, f[0] & mask], np.uint64).view(np.int64).tolist()
        return pa.RecordBatch.from_pydict({"block": [base + seq], "mask": [m], "pattern": [p], "fps": [f.tobytes()]},
                                          schema=_BLOCK_SCHEMA)
    for b in batches:
        held = np.concatenate([held, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        while len(held) >= 2 * BLOCK:
            yield row(held[:BLOCK])
            held, seq = held[BLOCK:], seq + 1
    if len(held):
        yield row(held)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("fps", pa.binary())])
_EDGE_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(most: int):
    def f(batches):
        for b in batches:
            for same, x, y in zip(b.column("same").to_pylist(), b.column("fps").to_pylist(),
                                  b.column("fps2").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = x if same else np.concatenate([x, y])
                shift = 0 if same else len(x)
                forest = _Forest(len(both))
                for i, j in _search(x, y, most):
                    j = j + shift
                    ok = i != j
                    forest.add(i[ok], j[ok])
                linked = np.nonzero(forest.up != np.arange(len(both)))[0]
                yield pa.RecordBatch.from_pydict({"u": both[linked].view(np.int64),
                                                  "v": both[forest.up[linked]].view(np.int64)}, schema=_EDGE_SCHEMA)
    return f


def link_forest(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """A spanning forest (u, v) of the links between distinct fingerprints ``fp`` at ``most``
    or fewer differing bits: at most one row for each fingerprint and block pair."""
    spark = fps.sparkSession
    n = fps.count()
    size = max(BLOCK, -(-n // (MAX_BLOCKS // 2)))
    parts = max(1, -(-n // size))
    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank")
    blocks = staged(ranked.sortWithinPartitions("rank").select("fp").mapInArrow(
        _pack, "block long, mask long, pattern long, fps binary"), "simhash-blocks")
    roots = blocks.select("block", "mask", "pattern").collect()
    ids = np.array([r[0] for r in roots], np.int64)
    masks = np.array([r[1] for r in roots], np.int64).view(np.uint64)
    patterns = np.array([r[2] for r in roots], np.int64).view(np.uint64)

    def partners(batches):  # blocks whose shared bits differ in ``most`` places at most
        for b in batches:
            for i, m, p, x in zip(*(b.column(c).to_pylist() for c in ("block", "mask", "pattern", "fps"))):
                m, p = np.array([m, p], np.int64).view(np.uint64)
                near = np.bitwise_count((patterns ^ p) & masks & m) <= most
                for j in ids[near & (ids >= i)].tolist():
                    yield pa.RecordBatch.from_pydict({"same": [i == j], "block": [j], "fps": [x]}, schema=schema)
    schema = pa.schema([("same", pa.bool_()), ("block", pa.int64()), ("fps", pa.binary())])
    tasks = blocks.mapInArrow(partners, "same boolean, block long, fps binary")
    pairs = tasks.join(blocks.select("block", F.col("fps").alias("fps2")), "block")
    return pairs.select("same", "fps", "fps2").mapInArrow(_links(most), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) for every end of ``edges``: equal labels for connected ends.

    Each round takes the smallest label of the neighbours, then the label of the label; it
    ends when nothing changes."""
    both = staged(edges.select("u", "v").union(edges.select("v", "u")), "simhash-links")
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "simhash-labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        new = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("far"))
        new = staged(new.join(jump, "l").select("u", F.least("l", "far").alias("l"), "old"), "simhash-labels")
        if new.where("l <> old").limit(1).count() == 0:
            return new.select(F.col("u").alias("fp"), F.col("l").alias("label"))
        labels = new.select("u", "l")


def fingerprint_groups(rows: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(fp, label, component_id) for every distinct fingerprint of ``rows`` (doc_id, fp)."""
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    edges = staged(link_forest(fps, most), "simhash-forest")
    named = fps.join(components(edges), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = staged(named, "simhash-named")
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(ids, "label").select("fp", "label", "component_id")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row."""
    arrow_batches(documents.sparkSession)
    rows = staged(documents.select("doc_id", fingerprint_udf(shingle)(F.col("text").cast("binary")).alias("fp")),
                  "simhash-rows")
    groups = staged(fingerprint_groups(rows, most), "simhash-groups")
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")


def drop_near_duplicates(documents: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """One row of ``documents`` for each component: the smallest doc_id, the first such row."""
    arrow_batches(documents.sparkSession)
    fp, rid = fresh(documents, "fingerprint", "row")
    both = staged(documents.select(*[F.col(f"`{c}`") for c in documents.columns],
                                   fingerprint_udf(shingle)(F.col("text").cast("binary")).alias(fp),
                                   F.monotonically_increasing_id().alias(rid)), "simhash-documents")
    rows = both.select("doc_id", F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    groups = fingerprint_groups(rows, most)
    # per fingerprint first, so that a hot one is a single row before the join
    firsts = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
                                    .alias("first"))
    keep = (firsts.join(groups, "fp").groupBy("label").agg(F.min("first").alias("first"))
            .select(F.col("first.rid").alias(rid)))
    return both.join(keep, rid, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
