"""Suffix-array dedup: remove every byte that a 50-byte string of an earlier document covers.

Documents are staged in shards. For pieces of a shard of bounded size a suffix array of all
text that can repeat there (see anchors below) is built in numpy by Larsson-Sadakane refinement: suffixes are sorted by 8 bytes, and then only the
groups that are still tied are sorted again by the ranks 8, 16 and 32 bytes further on. Common
prefixes of neighbours follow Kasai's observation (a pair that is its predecessor's pair moved
on by one byte has a common prefix shorter by one), so only the other pairs are compared. Runs
of neighbours that share 50 bytes are equal strings; all but those of the smallest doc_id of
the piece are removed at once.

Shards are merged without moving their texts. Every 50-byte string owns an anchor: the place of
its smallest 20-byte hash. Equal strings own equal anchors, so a shard only reports, for each
anchor of strings that it has not removed, the anchor's hash, a hash of the stretch that its
strings cover, and the doc_id. Sorted reports of all shards meet by hash range. An anchor found
once is settled. A stretch that an earlier document has too is removed whole. Where stretches
differ around one anchor (the ends of a shared passage), the shards are asked for those few
stretches, and their strings are merged one by one. Shards find what they are asked for by
binary search in the sorted answers.

The staged table is bucketed by shard, so the rounds with the shards' texts shuffle answers
only. Ranges hold a bounded number of anchors, whatever the size of the corpus.

Defined results: a null or empty text has 0 bytes and the checksum of nothing; texts shorter
than 50 bytes lose nothing; rows of one doc_id do not remove each other; a null doc_id counts
as larger than all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

from .common import arrow_batches, staged

SIZE = 50
GRAM = 20
#: Bytes of text that one suffix array covers (a longer document has an array of its own).
PIECE = 4_000_000
#: Rows of a shard, and most buckets of the staged table.
SHARD_ROWS, MAX_BUCKETS = 4096, 100_000
#: Bytes of corpus for each range of anchor hashes.
RANGE_BYTES = 2_000_000
NO_ID = (1 << 63) - 1
SEP = 0xFF  # never in UTF-8
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    return x ^ (x >> np.uint64(29))


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one big-endian number (separators after the end)."""
    t = np.concatenate([text, np.full(8, SEP, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | t[i:i + len(text)]
    return out


def suffix_array(text: np.ndarray, w8: np.ndarray) -> np.ndarray:
    """Places of ``text`` sorted by their next 64 bytes."""
    n = len(text)
    sa = np.argsort(w8, kind="stable")
    key = w8[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 64, np.int64)
    rank[n:] = n  # after every text, like the separator
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's first slot
    h = 8
    while h < 64:
        last = np.concatenate([first[1:], [True]])
        slots = np.nonzero(~(first & last))[0]  # of groups that are still tied
        if not len(slots):
            break
        p = sa[slots]
        key = rank[p].astype(np.uint64) << np.uint64(32) | rank[p + h].astype(np.uint64)
        order = np.argsort(key, kind="stable")  # ties stay in text order: long chains below
        key, p = key[order], p[order]
        sa[slots] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[slots] = new
        rank[p] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
    return sa


def _common(w8: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix from places a and b, to the last byte."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        inside = np.maximum(x, y) < len(w8)
        todo, x, y = todo[inside], x[inside], y[inside]
        diff = w8[x] ^ w8[y]
        same = diff == 0
        lead = np.zeros(len(todo), np.int64)
        if not same.all():
            # leading equal bytes of the eight
            high = diff[~same]
            lead[~same] = sum(((high >> np.uint64(56 - 8 * i)) == 0).astype(np.int64) for i in range(8))
        out[todo] += np.where(same, 8, lead)
        todo = todo[same]
    return np.minimum(out, len(w8) - np.maximum(a, b))


def common_prefixes(w8: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every place, the common prefix with its predecessor in the suffix array."""
    n = len(sa)
    before = np.full(n, -2, np.int64)
    before[sa[1:]] = sa[:-1]
    moved = np.zeros(n, bool)  # the pair of the place before, moved on by one
    moved[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    own = np.nonzero(~moved & (before >= 0))[0]
    lcp = np.zeros(n, np.int64)
    lcp[own] = _common(w8, own, before[own])
    start = np.maximum.accumulate(np.where(moved, -1, np.arange(n)))
    lcp = lcp[start] - (np.arange(n) - start)
    again = np.nonzero((lcp < 0) & moved)[0]  # the chain ran out: compare
    lcp[again] = _common(w8, again, before[again])
    return np.maximum(lcp, 0)


class Piece:
    """Documents end to end with separators between, and what their 50-byte strings need."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, texts: list[bytes]):
        self.ids, self.rows = ids, rows
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        self.w8 = words8(self.text)
        n = len(self.text)
        ends = self.begin + sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes + 1)
        self.valid = np.arange(n) + SIZE <= ends[self.doc]

    def repeated(self, found) -> np.ndarray:
        """Strings (by start) that a document of this piece with a smaller id has too.

        Equal strings own equal anchors, so the suffix array is over the stretches of the
        anchors (``found``) that occur more than once; no other string can repeat."""
        out = np.zeros(len(self.text), bool)
        if found is None:
            return out
        h, lo, hi, _ = found
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        lo, hi = lo[twice], hi[twice]
        if not len(lo):
            return out
        joined = (lo[1:] == hi[:-1] + 1) & (self.doc[lo[1:]] == self.doc[lo[:-1]])
        cut = np.nonzero(np.concatenate([[True], ~joined]))[0]
        lo, hi = lo[cut], hi[np.append(cut[1:], len(hi)) - 1]
        sizes = hi - lo + SIZE + 1  # with a separator
        nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(lo, sizes) + nth
        text = self.text[np.minimum(place, len(self.text) - 1)].copy()
        text[np.cumsum(sizes) - 1] = SEP
        w8 = words8(text)
        sa = suffix_array(text, w8)
        first = np.nonzero(common_prefixes(w8, sa)[sa] < SIZE)[0]
        if not len(first) or first[0]:
            first = np.concatenate([[0], first])
        string = nth <= np.repeat(hi - lo, sizes)  # a whole string starts here
        own = np.where(string, self.ids[self.doc[np.minimum(place, len(self.text) - 1)]], NO_ID)[sa]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(sa))))
        hit = sa[least < own]
        out[place[hit[string[hit]]]] = True
        return out

    def hash50(self, p: np.ndarray) -> np.ndarray:
        """Hash of the string at each place."""
        h = np.zeros(len(p), np.uint64)
        for at in (0, 8, 16, 24, 32, 40, SIZE - 8):
            h = _mix(h + self.w8[p + at]) * _C[0]
        return _mix(h)

    def anchors(self):
        """(hash, first string, last string, stretch hash) of every anchor, in text order."""
        n = len(self.text)
        p = np.nonzero(self.valid)[0]
        if not len(p):
            return None
        pad = np.concatenate([self.w8, np.zeros(SIZE, np.uint64)])
        h = _mix(_mix(pad[:n] * _C[0]) + pad[8:n + 8] * _C[1])
        h = _mix(h + pad[GRAM - 8:n + GRAM - 8] * _C[2])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width = SIZE - GRAM + 1
        low, span = key, 1  # smallest of the next ``span`` places
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low, np.concatenate([low[step:], np.full(step, ~np.uint64(0))]))
            span += step
        owner = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
        lo, hi = p[cut], p[np.append(cut[1:], len(p)) - 1]
        at = owner[cut]
        stretch = _mix(self.hash50(lo) * _C[1] + self.hash50(hi) * _C[2]
                       + ((hi - lo) * 64 + (at - lo)).astype(np.uint64))
        return h[at], lo, hi, stretch


def _pieces(ids, rows, texts):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > PIECE:
            yield Piece(ids[at:i], rows[at:i], texts[at:i])
            at, size = i, 0
        size += len(t) + 1
    if len(texts) > at:
        yield Piece(ids[at:], rows[at:], texts[at:])


def _table_pieces(docs: pa.Table):
    rows = docs.column("row").to_numpy()
    order = np.argsort(rows, kind="stable")  # the same pieces in every round
    ids = docs.column("id").to_numpy()[order]
    text = docs.column("text").to_pylist()
    yield from _pieces(ids, rows[order], [text[i] for i in order.tolist()])


def _runs(piece: Piece, places: np.ndarray):
    """Sorted string starts as runs (row, start in the document, strings)."""
    if not len(places):
        return None
    doc = piece.doc[places]
    cut = np.nonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(doc) != 0)]))[0]
    n = np.diff(np.append(cut, len(places)))
    return np.stack([piece.rows[doc[cut]], places[cut] - piece.begin[doc[cut]], n]).astype(np.int64)


_BLOB = "kind int, r long, shard long, a binary, b binary"
_BLOB_SCHEMA = pa.schema([("kind", pa.int32()), ("r", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()),
                          ("b", pa.binary())])
RUNS, ANCHORS, STRETCHES = 0, 1, 2


def _blob_table(rows) -> pa.Table:
    rows = list(rows)
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed(rec: np.ndarray) -> bytes:
    """Records byte by byte (all first bytes, all second ones ...), which compresses far better."""
    return rec.view(np.uint8).reshape(len(rec), -1).T.tobytes()


def _records(blob: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _by_range(kind, shard, h, record, ranges, extra=None):
    """Cut records into hash ranges: rows (kind, r, shard, records, extra)."""
    order = np.argsort(h, kind="stable")
    r = _range(h[order], ranges)
    cut = np.nonzero(np.diff(r))[0] + 1
    for part, x in zip(np.split(order, cut), r[np.concatenate([[0], cut])].tolist() if len(r) else []):
        yield kind, x, shard, _packed(record[part]), b"" if extra is None else extra[part].tobytes()


_ANCHOR = np.dtype([("h", "<u8"), ("s", "<u8"), ("id", "<i8")])


def _ask(h, s, ids):
    """One number for an anchor, its stretch and its document."""
    return _mix(_mix(h + s * _C[1]) + ids.astype(np.uint64) * _C[2])


def _reports(ranges: int):
    """Round 1: runs that a piece removes by itself, and reports of its other anchors."""
    def f(docs: pa.Table) -> pa.Table:
        shard = docs.column("shard")[0].as_py()

        def rows():
            for piece in _table_pieces(docs):
                found = piece.anchors()
                gone = piece.repeated(found)
                runs = _runs(piece, np.nonzero(gone)[0])
                if runs is not None:
                    yield RUNS, 0, shard, runs.tobytes(), b""
                if found is None:
                    continue
                h, lo, hi, stretch = found
                kept = np.concatenate([[0], np.cumsum(piece.valid & ~gone)])
                left = kept[hi + 1] > kept[lo]  # a string that is not removed yet
                h, lo, stretch = h[left], lo[left], stretch[left]
                rec = np.empty(len(h), _ANCHOR)
                rec["h"], rec["s"], rec["id"] = h, stretch, piece.ids[piece.doc[lo]]
                rec = np.unique(rec)
                yield from _by_range(ANCHORS, shard, rec["h"], rec, ranges)
        return _blob_table(rows())
    return f


def _meet(table: pa.Table) -> pa.Table:
    """A hash range of all shards: what each shard is to remove (1) or to send (2)."""
    shards = table.column("shard").to_numpy()
    parts = [_records(x, _ANCHOR) for x in table.column("a").to_pylist()]
    rec = np.concatenate(parts)
    shard = np.repeat(shards, [len(x) for x in parts])
    order = np.lexsort((rec["id"], rec["s"], rec["h"]))
    rec, shard = rec[order], shard[order]
    new_h = np.concatenate([[True], rec["h"][1:] != rec["h"][:-1]])
    new_s = new_h | np.concatenate([[True], rec["s"][1:] != rec["s"][:-1]])
    at_s, at_h = np.nonzero(new_s)[0], np.nonzero(new_h)[0]
    least = np.repeat(rec["id"][at_s], np.diff(np.append(at_s, len(rec))))
    classes = np.repeat(np.add.reduceat(new_s.astype(np.int64), at_h), np.diff(np.append(at_h, len(rec))))
    what = np.where(least < rec["id"], 1, np.where(classes > 1, 2, 0)).astype(np.uint8)
    key = _ask(rec["h"], rec["s"], rec["id"])

    def rows():
        hit = np.nonzero(what)[0]
        by = hit[np.argsort(shard[hit], kind="stable")]
        cut = np.nonzero(np.diff(shard[by]))[0] + 1
        for part in np.split(by, cut):
            if len(part):
                yield ANCHORS, 0, int(shard[part[0]]), key[part].tobytes(), what[part].tobytes()
    return _blob_table(rows())


_WIDTH = 2 * SIZE - GRAM
_STRETCH = np.dtype([("h", "<u8"), ("id", "<i8"), ("row", "<i8"), ("at", "<i8"), ("n", "<i8")])


def _send(ranges: int):
    """Round 2: remove what was asked for, and send the stretches of unsettled anchors."""
    def f(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return _blob_table([])
        shard = docs.column("shard")[0].as_py()
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in asked.column("a").to_pylist()])
        what = np.concatenate([np.frombuffer(x, np.uint8) for x in asked.column("b").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, what = key[order], what[order]

        def rows():
            for piece in _table_pieces(docs):
                found = piece.anchors()
                if found is None:
                    continue
                h, lo, hi, stretch = found
                own = _ask(h, stretch, piece.ids[piece.doc[lo]])
                p = np.minimum(np.searchsorted(key, own), len(key) - 1)
                do = np.where(key[p] == own, what[p], 0)
                out = np.zeros(len(piece.text) + 1, np.int32)
                np.add.at(out, lo[do == 1], 1)
                np.add.at(out, hi[do == 1] + 1, -1)
                runs = _runs(piece, np.nonzero(np.cumsum(out[:-1]) > 0)[0])
                if runs is not None:
                    yield RUNS, 0, shard, runs.tobytes(), b""
                h, lo, hi = h[do == 2], lo[do == 2], hi[do == 2]
                if len(h):
                    rec = np.empty(len(h), _STRETCH)
                    doc = piece.doc[lo]
                    rec["h"], rec["id"], rec["row"] = h, piece.ids[doc], piece.rows[doc]
                    rec["at"], rec["n"] = lo - piece.begin[doc], hi - lo + 1
                    wide = np.concatenate([piece.text, np.zeros(_WIDTH, np.uint8)])
                    text = wide[lo[:, None] + np.arange(_WIDTH)]
                    text[np.arange(_WIDTH) >= (hi - lo + SIZE)[:, None]] = 0
                    yield from _by_range(STRETCHES, shard, h, rec, ranges, text)
        return _blob_table(rows())
    return f


def _settle(table: pa.Table) -> pa.Table:
    """A hash range of stretches: the strings that an earlier document has too."""
    shards = table.column("shard").to_numpy()
    parts = [_records(x, _STRETCH) for x in table.column("a").to_pylist()]
    rec = np.concatenate(parts)
    shard = np.repeat(shards, [len(x) for x in parts])
    text = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8)
    w8 = words8(text)
    entry = np.repeat(np.arange(len(rec)), rec["n"])
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(rec["n"]) - rec["n"], rec["n"])
    p = entry * _WIDTH + nth
    code = np.zeros(len(p), np.uint64)
    for at in (0, 8, 16, 24, 32, 40, SIZE - 8):
        code = _mix(code + w8[p + at]) * _C[0]
    anchor, own = rec["h"][entry], rec["id"][entry]
    order = np.lexsort((own, code, anchor))
    same = (code[order][1:] == code[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    first = np.nonzero(np.concatenate([[True], ~same]))[0]
    least = np.repeat(own[order][first], np.diff(np.append(first, len(order))))
    gone = np.zeros(len(p), bool)
    gone[order] = least < own[order]

    def rows():
        hit = np.nonzero(gone)[0]
        e = entry[hit]
        runs = np.stack([rec["row"][e], rec["at"][e] + nth[hit], np.ones(len(hit), np.int64)])
        by = np.argsort(shard[e], kind="stable")
        for part in np.split(by, np.nonzero(np.diff(shard[e][by]))[0] + 1):
            if len(part):
                yield RUNS, 0, int(shard[e[part[0]]]), np.ascontiguousarray(runs[:, part]).tobytes(), b""
    return _blob_table(rows())


_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         ("kept", pa.binary())])


def _cut(docs: pa.Table, removed: pa.Table) -> pa.Table:
    """Remove the covered bytes of a shard's documents."""
    runs = [np.frombuffer(x, np.int64).reshape(3, -1) for x in removed.column("a").to_pylist()]
    runs = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
    runs = runs[:, np.argsort(runs[0], kind="stable")]
    out = []
    for doc_id, row, text in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(),
                                 docs.column("text").to_pylist()):
        a, b = np.searchsorted(runs[0], [row, row + 1])
        if a == b:
            out.append((doc_id, len(text), [], text))
            continue
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, runs[1, a:b], 1)
        np.add.at(step, runs[1, a:b] + runs[2, a:b] + SIZE - 1, -1)
        gone = np.cumsum(step)[:-1] > 0
        edges = np.nonzero(np.diff(np.concatenate([[False], gone, [False]])))[0].tolist()
        spans = [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])]
        out.append((doc_id, len(text), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT_SCHEMA)], schema=_OUT_SCHEMA)


def _shards(documents: DataFrame) -> DataFrame:
    """(shard, row, doc_id, id, text) bucketed by shard in the shared folder."""
    spark = documents.sparkSession
    at = F.monotonically_increasing_id()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce("text", F.lit("")).cast("binary").alias("text"), at.alias("at"))
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select((F.shiftright("at", 33) * (1 << 21) + F.floor(local / SHARD_ROWS)).cast("long").alias("shard"),
                       local.alias("row"), "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    buckets = min(MAX_BUCKETS, max(1, -(-documents.count() // SHARD_ROWS)))
    name = f"strata_shards_{uuid.uuid4().hex[:12]}"
    (rows.write.option("compression", "zstd").option("path", scratch_path(spark, "suffix-shards"))
     .bucketBy(buckets, "shard").saveAsTable(name))
    return spark.table(name)


def kept_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed spans (byte places, end exclusive) and the kept bytes of every row."""
    arrow_batches(documents.sparkSession)
    docs = _shards(documents)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    own = staged(docs.groupBy("shard").applyInArrow(_table(_reports(ranges)), _BLOB), "suffix-reports")
    asked = staged(own.where(F.col("kind") == ANCHORS).groupBy("r").applyInArrow(_table(_meet), _BLOB), "suffix-asked")
    send = _send(ranges)
    sent = staged(docs.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
        lambda a, b: send(a, b), _BLOB), "suffix-sent")
    late = staged(sent.where(F.col("kind") == STRETCHES).groupBy("r").applyInArrow(_table(_settle), _BLOB),
                  "suffix-settled")
    gone = own.where(F.col("kind") == RUNS).unionAll(sent.where(F.col("kind") == RUNS)).unionAll(late)
    return docs.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(lambda a, b: _cut(a, b), _OUT)


def dedup_spans(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return kept_texts(documents).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _table(f):
    """``f`` as a function that Spark sees with one argument."""
    return lambda t: f(t)
