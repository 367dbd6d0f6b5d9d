"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to :data:`ORDER` long, learned from the training
documents. A symbol's probability is its share of the longest context in which it was seen;
each longer context costs an escape, whose weight is the number of distinct symbols seen there,
and symbols already offered by a longer context are excluded from the counts of the shorter
ones. A text starts with ``ORDER`` begin bytes and ends with an end byte (two values that UTF-8
never uses), so the probabilities of all texts sum to one. The code length of a text is the sum
over its bytes; it depends only on its (ORDER + 1)-grams.

The trie is never sent whole anywhere. Documents are staged in files; a file is a chunk. Each
chunk reports its distinct grams and words with training counts, cut into ranges by the last
three context bytes (for words: by hash) and packed as binary columns. Ranges are merged in
two rounds, first salted by chunk, so a range met in every chunk is pre-aggregated. A range
holds all contexts with its endings, so orders down to three are computed there; the counts of
orders two and less are one table of at most 256^3 entries, sent to all tasks. Every chunk
gets back the costs of its own grams and the counts of its own words, and scores its documents.

Defined results: a null or empty text has the end token only; a null doc_id is in the training
part (checksum of an empty string); repeated rows count as often as they occur; without
training documents all bytes are equally likely; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

from .common import LOWER, arrow_batches, staged

ORDER = 5
RANGES = 1024
SALTS = 8
#: Documents of a chunk; a chunk is scored in one task.
CHUNK_ROWS = 8192
BEGIN, END = 0xFE, 0xFF
END_WORD = b"\n"
WORDS, GRAMS = 0, 1


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def text_grams(text: bytes) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at every byte of a lower-cased text and at its end."""
    a = np.frombuffer(bytes([BEGIN]) * ORDER + text + bytes([END]), np.uint8).astype(np.uint64)
    n = len(a) - ORDER
    g = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        g = g << np.uint64(8) | a[k:k + n]
    return g


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.add.reduceat(counts, at) if len(at) else counts)


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of ``wanted`` in sorted ``keys``, 0 where missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    p = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[p] == wanted, values[p], 0)


class Trie:
    """Counts of contexts: own grams for the long orders, a shared table for the short ones."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]):
        self.level = [None] * (ORDER + 1)
        keys, n = grams, counts
        for k in range(ORDER, -1, -1):
            if k == 2:
                keys, n = short
            if k < ORDER:
                keys, n = _sums(keys & _low(k + 1), n)
            self.level[k] = (keys, n)
        self.context = []
        for k, (keys, n) in enumerate(self.level):
            ctx = keys >> np.uint64(8)
            at = np.nonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))[0] if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(at, len(ctx)))
            # what the shorter context counts for the symbols seen here
            below = np.zeros(0, np.int64)
            if k and len(at):
                below = np.add.reduceat(_lookup(*self.level[k - 1], keys & _low(k)), at)
            self.context.append((ctx[at], total, distinct, below if k else np.zeros(len(at), np.int64)))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        gone = gone_symbols = np.zeros(len(grams), np.int64)  # excluded counts and symbols
        for k in range(ORDER, -1, -1):
            g = grams & _low(k + 1)
            keys, total, distinct, below = self.context[k]
            ctx = g >> np.uint64(8)
            t, d = _lookup(keys, total, ctx) - gone, _lookup(keys, distinct, ctx)
            left = d - gone_symbols
            c = _lookup(*self.level[k], g)
            hit = open_ & (c > 0)
            out[hit] += np.log10(c[hit] / (t + left)[hit])
            open_ &= ~hit
            esc = open_ & (left > 0)
            out[esc] += np.log10(left[esc] / (t + left)[esc])
            gone, gone_symbols = _lookup(keys, below, ctx), d
        out[open_] += -np.log10(256 - gone_symbols[open_])
        return out


_BLOB = "kind int, r int, chunk long, keys binary, counts binary"
_BLOB_SCHEMA = pa.schema([("kind", pa.int32()), ("r", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()),
                          ("counts", pa.binary())])


def _range_of(grams: np.ndarray) -> np.ndarray:
    suffix = (grams >> np.uint64(8)) & _low(3)
    return ((suffix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % RANGES


class _Chunk:
    """Distinct words and grams of a chunk with their training counts."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held, self.size = [], 0

    def add(self, doc_id, text: bytes) -> None:
        one = 0 if is_held_out(doc_id) else 1
        words = self.words
        for w in text.split():
            words[w] = words.get(w, 0) + one
        words[END_WORD] = words.get(END_WORD, 0) + one
        g = text_grams(text)
        self.held.append((g, one))
        self.size += len(g)
        if self.size > 2_000_000:
            self.fold()

    def fold(self) -> None:
        parts, counts = [self.keys], [self.counts]
        for one in (0, 1):
            own = [g for g, o in self.held if o == one]
            if own:
                u, n = np.unique(np.concatenate(own), return_counts=True)
                parts.append(u)
                counts.append(n * one)
        self.keys, self.counts = _sums(np.concatenate(parts), np.concatenate(counts))
        self.held, self.size = [], 0

    def rows(self, chunk: int):
        self.fold()
        by: list[list[bytes]] = [[] for _ in range(RANGES)]
        for w in self.words:
            by[zlib.crc32(w) % RANGES].append(w)
        for r, ws in enumerate(by):
            if ws:
                yield WORDS, r, chunk, b" ".join(ws), np.array([self.words[w] for w in ws], np.int64).tobytes()
        r = _range_of(self.keys)
        order = np.argsort(r, kind="stable")
        keys, counts, r = self.keys[order], self.counts[order], r[order]
        cuts = np.nonzero(np.diff(r))[0] + 1
        for k, n, x in zip(np.split(keys, cuts), np.split(counts, cuts), r[np.concatenate([[0], cuts])].tolist()):
            yield GRAMS, x, chunk, k.tobytes(), n.tobytes()


def _batches(rows, schema, size=256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _report(batches):
    def rows():
        chunk, held = None, None
        for b in batches:
            for c, d, t in zip(b.column("chunk").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                if c != chunk:
                    if held is not None:
                        yield from held.rows(chunk)
                    chunk, held = c, _Chunk()
                held.add(d, t.as_py().translate(LOWER))
        if held is not None:
            yield from held.rows(chunk)
    return _batches(rows(), _BLOB_SCHEMA)


def _merge(batches):
    """Sum the counts of one (kind, r, chunk) after the other; keys without counts go."""
    def close(key, words, keys, counts):
        if key[0] == WORDS:
            kept = [w for w, n in words.items() if n]
            return *key, b" ".join(kept), np.array([words[w] for w in kept], np.int64).tobytes()
        k, n = _sums(np.concatenate(keys), np.concatenate(counts))
        return *key, k[n > 0].tobytes(), n[n > 0].tobytes()

    def rows():
        key, words, keys, counts, size = None, {}, [], [], 0
        for b in batches:
            for kind, r, c, k, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != (kind, r, c):
                    if key is not None:
                        yield close(key, words, keys, counts)
                    key, words, keys, counts, size = (kind, r, c), {}, [], [], 0
                n = np.frombuffer(n, np.int64)
                if kind == WORDS:
                    for w, x in zip(k.split(b" "), n.tolist()):
                        words[w] = words.get(w, 0) + x
                else:
                    keys.append(np.frombuffer(k, np.uint64))
                    counts.append(n)
                    size += len(n)
                    if size > 2_000_000 and len(keys) > 8:
                        k, n = _sums(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, size = [k], [n], 0
        if key is not None:
            yield close(key, words, keys, counts)
    return _batches(rows(), _BLOB_SCHEMA, 64)


def _short_counts(batches):
    """Counts of order 2: (gram of three bytes, count) of each range."""
    for b in batches:
        for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
            k, n = _sums(np.frombuffer(k, np.uint64) & _low(3), np.frombuffer(n, np.int64))
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int64), "n": n})


def _answer(short):
    """Rows of a range, its model first (without chunk), then the chunks' keys -> for each chunk the counts
    of its words and the costs of its grams."""
    def f(batches):
        def rows():
            last, known = None, None
            for b in batches:
                for kind, r, chunk, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "r", "chunk", "keys", "counts"))):
                    if (kind, r) != last:
                        mk, n = (keys, np.frombuffer(counts, np.int64)) if chunk is None else (b"", np.empty(0, np.int64))
                        if kind == WORDS:
                            known = dict(zip(mk.split(b" "), n.tolist()))
                        else:
                            known = Trie(np.frombuffer(mk, np.uint64), n, short.value)
                        last = (kind, r)
                    if chunk is None:
                        continue
                    if kind == WORDS:
                        values = np.array([known.get(w, 0) for w in keys.split(b" ")], np.int64)
                    else:
                        values = known.log10(np.frombuffer(keys, np.uint64))
                    yield kind, r, chunk, keys, values.tobytes()
        return _batches(rows(), _BLOB_SCHEMA, 64)
    return f


def _cost_sums(grams: np.ndarray, cost: np.ndarray, parts: list[np.ndarray]) -> list[float]:
    """The summed costs of each part's grams, looked up in ascending order, which memory caches like."""
    g = np.concatenate(parts)
    order = np.argsort(g)
    sorted_ = g[order]
    p = np.minimum(np.searchsorted(grams, sorted_), max(0, len(grams) - 1))
    if not np.array_equal(grams[p], sorted_):
        raise RuntimeError("a gram of this chunk has no answer")
    own = np.empty(len(g))
    own[order] = cost[p]
    ends = np.cumsum([len(x) for x in parts]).tolist()
    return [float(own[x:y].sum()) for x, y in zip([0, *ends], ends)]


_OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double")
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                         ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                         ("score", pa.float64())])


def _score(n_train: int, n_distinct: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        keys, costs = [], []
        for kind, k, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
            if kind == WORDS:
                counts.update(zip(k.split(b" "), np.frombuffer(v, np.int64).tolist()))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                costs.append(np.frombuffer(v, np.float64))
        grams, cost = np.concatenate(keys), np.concatenate(costs)
        order = np.argsort(grams, kind="stable")
        grams, cost = grams[order], cost[order]
        out, parts, sums, size = [], [], [], 0
        for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text")):
            text = t.as_py().translate(LOWER)
            c = np.array([counts[w] for w in text.split()] + [counts[END_WORD]], np.int64)
            base = np.log10((c + 0.5) / (n_train + 0.5 * (n_distinct + 1))).sum()
            out.append((d, is_held_out(d), len(c), int((c > 0).sum()), n_train, float(base)))
            parts.append(text_grams(text))
            size += len(parts[-1])
            if size > 1_000_000:
                sums += _cost_sums(grams, cost, parts)
                parts, size = [], 0
        if parts:
            sums += _cost_sums(grams, cost, parts)
        rows = [(*o, x) for o, x in zip(out, sums, strict=True)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _OUT_SCHEMA)], schema=_OUT_SCHEMA)
    return f


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = documents.sparkSession
    arrow_batches(spark)
    path = scratch_path(spark, "ppm-documents")
    (documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce("text", F.lit("")).cast("binary").alias("text"))
     .write.option("compression", "zstd").option("maxRecordsPerFile", CHUNK_ROWS).parquet(path))
    docs = spark.read.schema("doc_id long, text binary").parquet(path).select(
        F.xxhash64("_metadata.file_path").alias("chunk"), "doc_id", "text")
    blobs = staged(docs.mapInArrow(_report, _BLOB), "ppm-chunks")
    salted = blobs.withColumn("chunk", F.pmod("chunk", F.lit(SALTS)))
    some = (salted.repartition("kind", "r", "chunk").sortWithinPartitions("kind", "r", "chunk")
            .mapInArrow(_merge, _BLOB).withColumn("chunk", F.lit(0).cast("long")))
    model = staged(some.repartition("kind", "r").sortWithinPartitions("kind", "r").mapInArrow(_merge, _BLOB)
                   .drop("chunk"), "ppm-model")
    totals = model.where(F.col("kind") == WORDS).mapInArrow(_word_totals, "n long, v long").agg(
        F.sum("n"), F.sum("v")).first()
    rows = (model.where(F.col("kind") == GRAMS).mapInArrow(_short_counts, "k long, n long")
            .groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow())
    short = (rows.column("k").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64))
    sent = spark.sparkContext.broadcast(short)
    # each range's model once, before the keys that the chunks ask of it
    none = F.lit(None)
    asked = (model.select("kind", "r", none.cast("long").alias("chunk"), "keys", "counts")
             .unionByName(blobs.select("kind", "r", "chunk", "keys", none.cast("binary").alias("counts")))
             .repartition("kind", "r").sortWithinPartitions("kind", "r", F.asc_nulls_first("chunk")))
    answers = asked.mapInArrow(_answer(sent), _BLOB).select("chunk", "kind", "keys", "counts")
    score = _score(totals[0] or 0, totals[1] or 0)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda a, b: score(a, b), _OUT)


def _word_totals(batches):
    for b in batches:
        for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
            n = np.frombuffer(n, np.int64)
            yield pa.RecordBatch.from_pydict({"n": [int(n.sum())], "v": [len(n)]})
