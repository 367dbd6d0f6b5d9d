"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns, each reduced to a 128-bit digest and a length before anything is
shuffled. Positions are cut into blocks of :data:`BLOCK` turns at fixed places. Conversations are first
grouped by successive block digests alone: a block's key is the digest of all before it and its own
turns, so one grouping brings together all that share a prefix up to there, one row for each
different block. Only where blocks with one beginning differ (siblings diverge) are turns compared: those
blocks, one copy of each, are cut at turn boundaries and grouped again. A block without siblings
gives its turns' nodes as they are.

The digest of everything before a block comes from a scan over blocks of growing size (turns, spans,
spans of spans), so a conversation of any length is spread over many rows and tasks; turn numbers
come from a range sort and the counts of the partitions before.

Sums over subtrees need no walk. Every conversation owns the nodes of which it is the smallest member,
a path from some node down to its end, so the nodes below v are the owned paths of v's members, and
their lengths and leaves add up by the same grouping. The ids of the conversations that end at a node
are sorted and joined in parallel pieces, and the pieces of a node hashed one after the other.

Defined results: rows with a null conv_id belong to no conversation; a null turn comes first; turns
with equal numbers are ordered by the digest of (role, text), and repeated rows are turns of their own;
null roles and texts are empty. An empty table has no nodes. ``c % 100`` takes the sign of c. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK = 4                # turns of a block
SPAN = 256               # turns of a row while digests are chained; a multiple of BLOCK
FAN = 64                 # spans of a larger span
PIECE = 1 << 16          # bytes of joined ids in one row
ROOT = bytes(16)


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


# ---- turns in order -------------------------------------------------------------------------

def _ordinals(batches):
    """Sorted rows (conv_id, digest, size) -> with the partition and the place in it."""
    from pyspark import TaskContext
    part, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        if not len(conv):
            continue
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        at = np.arange(len(conv))
        start = np.maximum.accumulate(np.where(new, at, -1))
        place = at - np.maximum(start, 0) + np.where(start < 0, n, 0)
        last, n = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)),
                                          pa.array(place), b.column(1), b.column(2)],
                                         names=["conv_id", "part", "place", "digest", "size"])


def ordered_turns(conversations: DataFrame):
    """(turns, counts): turns (conv_id, idx, digest, size) numbered from 0 in every conversation, and
    (conv_id, own) with the number of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps (role, text) apart from other cuts of the same characters
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    keys = F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()
    rows = (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                    F.length(text).cast("long").alias("size"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "digest", "size"))
    rows = staged(rows.mapInArrow(_ordinals, "conv_id long, part int, place long, digest binary, size long"), "trie-turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    # at most one conversation of a partition began in an earlier one: as many rows as partitions
    late = parts.where("before > 0").select("conv_id", "part", "before")
    turns = rows.join(F.broadcast(late), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("idx"), "digest", "size")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("own"))


def rebuilt_turns(conversations: DataFrame):
    """(turns, lengths): turns (conv_id, pos, digest, size, total) of the rebuilt conversations and
    (conv_id, total) with the number of their turns, also 0.

    With h = crc32(conv_id as text) % 6, conversation c starts with the first h turns of conversation
    c - c % 100 (all if it has fewer) and goes on with its own turns after its first h."""
    turns, counts = ordered_turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = (turns.where((F.col("conv_id") % 100 == 0) & (F.col("idx") < 5)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "size"))).alias("head")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    info = (counts.withColumns({"base": base, "h": h}).join(heads, "base", "left")
            .withColumn("p", F.least("h", F.coalesce(F.array_size("head"), F.lit(0)))))
    info = staged(info.select("conv_id", "h", "p", F.slice("head", 1, F.col("p").cast("int")).alias("head"),
                              (F.col("p") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "trie-info")
    tail = turns.join(info.select("conv_id", "h", "p", "total"), "conv_id").where("idx >= h").select(
        "conv_id", (F.col("idx") - F.col("h") + F.col("p")).alias("pos"), "digest", "size", "total")
    head = info.select("conv_id", "total", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.idx").alias("pos"), "t.digest", "t.size", "total")
    return head.union(tail.select(*head.columns)), info.select("conv_id", "total")


# ---- digests of everything before -----------------------------------------------------------

def _chain(fan: int):
    """Groups (conv_id, kids, start, before, end) -> (conv_id, k, start, before, end) of each kid."""
    def f(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                acc, before = r["start"], r["before"]
                for j, kid in enumerate(r["kids"]):
                    nxt = _hash(b"s", acc, kid["digest"])
                    if j == fan - 1 and r["end"] is not None:
                        nxt = r["end"]
                    out.append((r["conv_id"], kid["k"], acc, before, nxt))
                    acc, before = nxt, before + kid["size"]
            yield _batch(out, _CHAIN)
    return f


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


_CHAIN = pa.schema([("conv_id", pa.int64()), ("k", pa.int64()), ("start", pa.binary()), ("before", pa.int64()),
                    ("end", pa.binary())])


def _starts(spans: DataFrame, fan: int) -> DataFrame:
    """(conv_id, k, start, before, end) for spans (conv_id, k, digest, size): the digest and code points
    of all before a span, and the digest up to its end."""
    group = spans.groupBy("conv_id", F.floor(F.col("k") / fan).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("k", "digest", "size"))).alias("kids"))
    group = staged(group, "trie-groups")
    if (group.agg(F.max("g")).first()[0] or 0) == 0:
        top = group.withColumns({"start": F.lit(ROOT), "before": F.lit(0).cast("long"), "end": F.lit(None).cast("binary")})
    else:
        joined = F.array_join(F.transform("kids", lambda x: F.hex(x["digest"])), "")
        up = group.select("conv_id", F.col("g").alias("k"), F.unhex(F.substring(F.sha2(joined, 256), 1, 32)).alias("digest"),
                          F.aggregate("kids", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("size"))
        top = group.join(_starts(up, fan).withColumnRenamed("k", "g"), ["conv_id", "g"])
    return staged(top.select("conv_id", "kids", "start", "before", "end").mapInArrow(
        _chain(fan), "conv_id long, k long, start binary, before long, end binary"), "trie-starts")


def _cut(block: int, span: int):
    """Spans -> blocks (conv_id, depth, start, before, digests, sizes, end, stop): ``end`` is the digest
    up to the end of a full block, ``stop`` the node at which the conversation ends, if it does here."""
    def f(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                digests = [t["digest"] for t in r["turns"]]
                sizes = [t["size"] for t in r["turns"]]
                acc, before, depth = r["start"], r["before"], r["k"] * span
                for at in range(0, len(digests), block):
                    own, size = digests[at:at + block], sizes[at:at + block]
                    end = stop = None
                    if len(own) == block:
                        end = _hash(b"b", acc, *own)
                        if at + block == span and r["end"] is not None:
                            end = r["end"]
                    if depth + len(own) == r["total"]:
                        stop = _nodes_of(acc, own, end)[-1]
                    out.append((r["conv_id"], depth, acc, before, b"".join(own), np.array(size, "<i8").tobytes(), end, stop))
                    acc, before, depth = end, before + sum(size), depth + len(own)
            yield _batch(out, _BLOCKS)
    return f


_BLOCKS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("start", pa.binary()), ("before", pa.int64()),
                     ("digests", pa.binary()), ("sizes", pa.binary()), ("end", pa.binary()), ("stop", pa.binary())])


def _nodes_of(start: bytes, digests: list[bytes], end: bytes | None) -> list[bytes]:
    """Ids of the nodes after each turn of a block."""
    out = []
    for d in digests:
        out.append(_hash(b"t", out[-1] if out else start, d))
    if end is not None:
        out[-1] = end
    return out


def blocks_of(turns: DataFrame, block: int, span: int, fan: int) -> DataFrame:
    """Blocks of rebuilt conversations, each with the code points (``points``) of its conversation."""
    spans = turns.groupBy("conv_id", F.floor(F.col("pos") / span).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("turns"), F.max("total").alias("total"))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    spans = staged(spans.withColumn("size", size), "trie-spans")
    joined = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    short = spans.select("conv_id", "k", F.unhex(F.substring(F.sha2(joined, 256), 1, 32)).alias("digest"), "size")
    points = spans.groupBy("conv_id").agg(F.sum("size").alias("points"))
    full = spans.join(_starts(short, fan), ["conv_id", "k"]).select("conv_id", "k", "turns", "total", "start", "before", "end")
    blocks = full.mapInArrow(_cut(block, span), "conv_id long, depth long, start binary, before long, digests binary, sizes binary, "
                                   "end binary, stop binary")
    return staged(blocks.join(points, "conv_id"), "trie-blocks")


# ---- nodes ------------------------------------------------------------------------------------

_EDGE = ["start", "depth", "before", "digests", "sizes", "end"]


def _turn_nodes(*sums: str):
    """Blocks -> a row for each of their turns: (node, parent, depth, size, before, alone, *sums)."""
    def f(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            many = []
            for start, depth, before, blob, sizes, end, alone in zip(*(b.column(c).to_pylist() for c in [*_EDGE, "alone"])):
                ids = _nodes_of(start, [blob[i:i + 16] for i in range(0, len(blob), 16)], end)
                size = np.frombuffer(sizes, "<i8")
                many.append(len(ids))
                for col, x in zip(cols, (ids, [start, *ids[:-1]], range(depth + 1, depth + 1 + len(ids)), size.tolist(),
                                         (before + np.cumsum(size) - size).tolist(), [alone] * len(ids))):
                    col.extend(x)
            types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            rest = [pa.array(np.repeat(b.column(s).to_numpy(), many)) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + rest,
                                             names=["node", "parent", "depth", "size", "before", "alone", *sums])
    return f


def _nodes(edges: DataFrame, siblings: DataFrame, sums: dict) -> DataFrame:
    """Nodes of the turns in ``edges``. Blocks without siblings are taken as they are; only turns of
    diverging blocks are grouped. ``sums`` maps a column to its aggregate over blocks."""
    rows = edges.join(siblings, "start").mapInArrow(
        _turn_nodes(*sums), "node binary, parent binary, depth long, size long, before long, alone boolean, "
        + ", ".join(f"{s} long" for s in sums))
    key = ["node", "parent", "depth", "size", "before"]
    rows = staged(rows, "trie-block-turns")
    merged = rows.where("not alone").groupBy(*key).agg(*[f(s).alias(s) for s, f in sums.items()])
    return rows.where("alone").select(*key, *sums).union(merged)


def _pieces(most: int):
    """Sorted (node, conv_id) -> (node, first, ids, sha): a run of ids that ends within the partition and
    began in it is hashed here; other runs leave as pieces of joined ids, about ``most`` bytes each."""
    def f(batches):
        node = first = None
        held, size, begun, whole = [], 0, False, False  # the first run may have begun in an earlier partition

        def row():
            ids = ",".join(held).encode()
            return (node, first, None, hashlib.sha256(ids).hexdigest()) if whole else (node, first, ids, None)
        for b in batches:
            out = []
            for nid, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if nid != node:
                    if held:
                        out.append(row())
                    whole, begun = begun, True
                    node, first, held, size = nid, conv, [], 0
                elif size >= most:
                    whole = False
                    out.append(row())
                    first, held, size = conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _batch(out, _PIECES)
        if held:
            whole = False  # it may go on in the next partition
            yield _batch([row()], _PIECES)
    return f


_PIECES = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary()), ("sha", pa.string())])


def _joined(batches):
    """Pieces sorted by (node, first) -> (node, sha), one piece at a time."""
    node, sha = None, None
    for b in batches:
        out = []
        for nid, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if nid != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = nid, hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
        yield _batch(out, _HASHES)
    if node is not None:
        yield _batch([(node, sha.hexdigest())], _HASHES)


_HASHES = pa.schema([("node", pa.binary()), ("sha", pa.string())])


def _end_hashes(ends: DataFrame, piece: int) -> DataFrame:
    """(node, sha) of the ids of the conversations that end at each node."""
    rows = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = staged(rows.mapInArrow(_pieces(piece), "node binary, first long, ids binary, sha string"), "trie-end-pieces")
    open_ = pieces.where("sha is null").repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return pieces.where("sha is not null").select("node", "sha").union(open_.mapInArrow(_joined, "node binary, sha string"))


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, span: int = SPAN, fan: int = FAN,
         piece: int = PIECE) -> DataFrame:
    """The nodes of the trie over conversations given as ``turns`` (conv_id, pos, digest, size, total) and
    ``lengths`` (conv_id, total), which also has the conversations without turns."""
    if block < 1 or span % block or fan < 2:
        raise ValueError("span must be a multiple of block, and fan at least 2")
    lengths = staged(lengths, "trie-lengths")
    blocks = blocks_of(turns, block, span, fan)
    edges = blocks.groupBy(*_EDGE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"),
                                       F.sum("points").alias("points"))
    edges = staged(edges, "trie-edges")
    siblings = edges.groupBy("start").agg((F.count(F.lit(1)) == 1).alias("alone"))
    nodes = _nodes(edges, siblings, {"n": F.sum, "rep": F.min, "points": F.sum})
    members = lengths.select(F.lit(1).alias("n"), "conv_id", F.lit(0).alias("points")).union(
        blocks.where("depth = 0").select(F.lit(0), F.lit(None).cast("long"), "points"))
    root = members.agg(F.sum("n").alias("n"), F.min("conv_id").alias("rep"), F.sum("points").alias("points")).where("n > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"),
                       *[F.lit(0).cast("long").alias(c) for c in ("depth", "size", "before")], "n", "rep", "points")
    nodes = staged(nodes.union(root), "trie-nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = staged(nodes.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "trie-counted")
    up = nodes.select(F.col("node").alias("parent"), F.col("rep").alias("above"))
    nodes = staged(nodes.join(up, "parent", "left"), "trie-parents")
    # the node from which a conversation is the smallest member, and whether its end is a leaf
    heads = nodes.where("above is null or above <> rep").select(F.col("rep").alias("conv_id"), F.col("before").alias("skip"))
    leaves = nodes.where("kids = 0").select(F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    owners = staged(heads.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long"))),
                    "trie-owners")
    owned = (blocks.join(owners, "conv_id").groupBy(*_EDGE)
             .agg(F.sum(F.col("points") - F.col("skip")).alias("owned"), F.sum("leaf").alias("leaves")))
    below = _nodes(owned, siblings, {"owned": F.sum, "leaves": F.sum}).select("node", "owned", "leaves")
    points = blocks.where("depth = 0").select("conv_id", "points")
    all_ = (owners.join(points, "conv_id", "left")
            .agg(F.sum(F.coalesce("points", F.lit(0)) - F.col("skip")).alias("owned"), F.sum("leaf").alias("leaves")))
    below = below.union(all_.select(F.lit(ROOT).alias("node"), "owned", "leaves"))
    ends = blocks.where("stop is not null").select(F.col("stop").alias("node"), "conv_id").union(
        lengths.where("total = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    out = (nodes.join(below, "node").join(owners.select(F.col("conv_id").alias("rep"), "skip"), "rep")
           .join(_end_hashes(ends, piece), "node", "left"))
    # code points of all members from here on, less those of the distinct nodes from here on
    distinct = F.col("owned") + F.col("skip") - F.col("before")
    return out.select(F.col("rep").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"),
                      F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                      (F.col("points") - F.col("n") * F.col("before") - distinct).alias("saved_tokens"),
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **sizes) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(*rebuilt_turns(conversations), **sizes)
