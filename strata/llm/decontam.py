"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and benchmark items are sequences of words (runs of letters, digits and underscores,
lower case). The CGK random walk reads a word sequence x: step t emits x[i] and moves on when
the random bit of (t, x[i]) is one. Two walks under the same bits meet again soon after an
edit, so edit distance turns into Hamming distance of the emitted sequences. One repetition
samples :data:`SAMPLED` positions of the walk; an item and an item-sized window that emit the
same words there are candidates. Repetitions with other bits and positions are added until
simulated copies of the items, edited up to the allowed distance, are found with the target
recall. Every candidate is verified by the exact edit distance between the item and the best
matching stretch of the text around the window.

Before the walk, windows that cannot match are skipped without loss: an item of n words at
distance d keeps n - 1 - 2d of its word pairs, and the window loses at most d more at its end.

The items are a stated query set: they are read in blocks of bounded size
(:data:`BLOCK_CHARS`), and each block is compared with all documents in one scan. Documents
are never shuffled; a row leaves a task for each item that a document holds.

Defined results: null or empty texts and items match nothing; an item without words is left
out; a repeated document row gives repeated result rows; items with one text are found alike;
a null doc_id is kept as null; other columns are ignored or, in :func:`drop_leaks`, carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import arrow_batches, fresh

SIMILARITY = 0.8
RECALL = 0.99
SAMPLED = 3
#: Edited copies of each size class that the repetitions are tried on.
TRIALS = 400
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(n_symbols: int, rep: int, steps: int) -> np.ndarray:
    """Random bits of the walk: bit t of word [t // 64, x] belongs to step t at symbol x."""
    x = np.arange(n_symbols, dtype=np.uint64)
    return np.stack([_mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rep * 100003 + k))
                     for k in range(-(-steps // 64))])


def walk_keys(seq: np.ndarray, starts: np.ndarray, n_symbols: int, rep: int, positions: np.ndarray) -> np.ndarray:
    """CGK walk from every start through ``seq``; the hash of the words at ``positions``.

    ``seq`` (symbols below ``n_symbols``) ends with enough zeros, the padding symbol, for the
    longest walk."""
    i, out = starts, np.zeros(len(starts), np.uint64)
    last, wanted = int(positions.max()), set(positions.tolist())
    bits = _bits(n_symbols, rep, last + 1)
    for t in range(last + 1):
        sym = seq[i]
        if t in wanted:
            out = _mix(out * np.uint64(31) + sym.astype(np.uint64) + np.uint64(1))
        step = bits[t >> 6][sym] >> np.uint64(t & 63) & np.uint64(1)
        i = i + step.view(np.int64)
    return out


def best_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``; the end of the first."""
    j = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for a, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = a
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j  # insertions from the left
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Index:
    """A block of benchmark items, ready to be sent to the tasks."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    similarity: float
    pairs: np.ndarray = field(default=None)  # sorted codes of the items' word pairs
    classes: list = field(default_factory=list)  # per size class: (size, members, [(positions, keys, owners)])

    def allowed(self, n: int) -> int:
        return int(np.floor((1 - self.similarity) * n + 1e-9))


def _class_of(n: int) -> int:
    """Sizes within a quarter share a class; its size is the smallest of them."""
    size = 1
    while size * 5 // 4 + 1 <= n:
        size = size * 5 // 4 + 1
    return size


def build_index(rows: list[tuple[int, str]], similarity: float, recall: float, seed: int = 7) -> Index:
    vocabulary: dict[str, int] = {}
    items = []
    for item_id, text in rows:
        ws = tokens(text)
        if ws:
            items.append((item_id, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64)))
    index = Index(vocabulary, items, similarity)
    codes = [x[:-1] << 32 | x[1:] for _, x in items]
    index.pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    rng, n_symbols = np.random.default_rng(seed), len(vocabulary) + 1
    by_class: dict[int, list[int]] = {}
    for k, (_, x) in enumerate(items):
        by_class.setdefault(_class_of(len(x)), []).append(k)
    for size, members in sorted(by_class.items()):
        own = [items[k][1] for k in members]
        trials = [own[t % len(own)] for t in range(TRIALS)]
        edited = [_edited(x, index, rng, len(vocabulary)) for x in trials]
        found, tables = np.zeros(TRIALS, bool), []
        while found.mean() < recall and len(tables) < 400:
            rep = len(tables)
            # a walk of 2n steps reads about n words
            steps = max(1, 2 * size)
            positions = np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))
            keys = _keys_of(own, n_symbols, rep, positions)
            order = np.argsort(keys, kind="stable")
            tables.append((positions, keys[order], np.array(members)[order]))
            found |= keys[np.arange(TRIALS) % len(own)] == _keys_of(edited, n_symbols, rep, positions)
        index.classes.append((size, max(len(items[k][1]) for k in members), tables))
    return index


def _keys_of(seqs: list[np.ndarray], n_symbols: int, rep: int, positions: np.ndarray) -> np.ndarray:
    """:func:`walk_keys` from the start of every sequence."""
    pad = np.zeros(int(positions.max()) + 2, np.int64)
    starts = np.cumsum([0] + [len(x) + len(pad) for x in seqs[:-1]])
    return walk_keys(np.concatenate([y for x in seqs for y in (x, pad)]), starts, n_symbols, rep, positions)


def _edited(x: np.ndarray, index: Index, rng, n_words: int) -> np.ndarray:
    """A copy of ``x`` with as many random edits as are allowed."""
    y = x.tolist()
    for _ in range(index.allowed(len(x))):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(y))))
        if kind == 0 and y:
            y[at] = int(rng.integers(n_words + 1))
        elif kind == 1:
            y.insert(at, int(rng.integers(n_words + 1)))
        elif len(y) > 1:
            del y[at]
    return np.array(y, np.int64)


def find(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, item words, edit distance, end word) of every item that each text holds.

    The texts are laid end to end with padding between, so one walk serves them all."""
    get = index.vocabulary.get
    out: list[list] = [[] for _ in texts]
    seqs = [[get(w, 0) for w in tokens(t)] for t in texts]
    if not index.items or not any(seqs):
        return out
    # a walk from the last word of a text ends in the padding after it
    pad = 2 * max(c[0] for c in index.classes) + 2
    sizes = np.array([len(x) for x in seqs], np.int64)
    begin = np.cumsum(sizes + pad) - (sizes + pad)
    seq = np.zeros(int((sizes + pad).sum()), np.int64)
    for at, x in zip(begin.tolist(), seqs):
        seq[at:at + len(x)] = x
    code = seq[:-1] << 32 | seq[1:]
    at = np.nonzero((seq[:-1] != 0) & (seq[1:] != 0))[0]
    hit = np.zeros(len(seq) + 1, np.int32)
    if len(at) and len(index.pairs):
        p = np.minimum(np.searchsorted(index.pairs, code[at]), len(index.pairs) - 1)
        hit[at[index.pairs[p] == code[at]] + 1] = 1
    total = np.cumsum(hit)  # pairs of items that start before each place
    found: dict[tuple[int, int], list[int]] = {}
    for size, largest, tables in index.classes:
        n = np.arange(size, largest + 1)
        d = np.array([index.allowed(x) for x in n.tolist()])
        least = int((n - 1 - 3 * d).min())
        if least > 0:
            ends = np.minimum(np.arange(len(seq)) + largest + int(d.max()), len(seq))
            starts = np.nonzero(total[ends] - total[:-1] >= least)[0]
        else:  # items so short that they may keep no pair
            starts = np.arange(len(seq))
        # a place in the padding is no window
        doc = np.searchsorted(begin, starts, "right") - 1
        inside = starts - begin[doc] < sizes[doc]
        starts, doc = starts[inside], doc[inside]
        if not len(starts):
            continue
        for rep, (positions, keys, owners) in enumerate(tables):
            own = walk_keys(seq, starts, len(index.vocabulary) + 1, rep, positions)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            ok = hi > lo
            for s, i, a, b in zip(starts[ok].tolist(), doc[ok].tolist(), lo[ok].tolist(), hi[ok].tolist()):
                for k in owners[a:b].tolist():
                    found.setdefault((i, k), []).append(s)
    for (i, k), at in found.items():
        item_id, x = index.items[k]
        n, d, b, e = len(x), index.allowed(len(x)), int(begin[i]), int(begin[i] + sizes[i])
        best, spans = (d + 1, 0), []
        for s in sorted(set(at)):  # overlapping windows are verified as one stretch
            lo, hi = max(b, s - d), min(e, s + n + 2 * d)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            dist, end = best_distance(x, seq[lo:hi])
            if dist < best[0]:
                best = (dist, lo + end - b)
        if best[0] <= d:
            out[i].append((item_id, n, *best))
    return [sorted(x) for x in out]


def _blocks(benchmark: DataFrame):
    """The items in blocks of at most :data:`BLOCK_CHARS` characters (or one item)."""
    held, size = [], 0
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if held and size + len(r[1]) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()),
                     ("edit_distance", pa.int64()), ("end_word", pa.int64())])


def leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
          recall: float = RECALL) -> DataFrame:
    """One row for each document and each benchmark item that it holds: doc_id, item_id,
    item_words, edit_distance (of the best stretch), end_word (where that ends), similarity."""
    spark = documents.sparkSession
    arrow_batches(spark)
    out = None
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(build_index(block, similarity, recall))

        def scan(batches, sent=sent):
            index = sent.value
            for b in batches:
                rows = [(d, *x) for d, own in zip(b.column("doc_id").to_pylist(),
                                                  find(index, b.column("text").to_pylist())) for x in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)
        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            scan, "doc_id long, item_id long, item_words long, edit_distance long, end_word long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, item_words long, edit_distance long, end_word long")
    return out.withColumn("similarity", 1 - F.col("edit_distance") / F.col("item_words"))


def _holds(sent):
    @pandas_udf("boolean")
    def f(text: pd.Series) -> pd.Series:
        return pd.Series([bool(x) for x in find(sent.value, text.tolist())], dtype=bool)
    return f


def drop_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
               recall: float = RECALL) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item."""
    spark: SparkSession = documents.sparkSession
    arrow_batches(spark)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    (hit,) = fresh(documents, "leak")
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(build_index(block, similarity, recall))
        documents = documents.withColumn(hit, _holds(sent)(F.col("text"))).where(~F.col(hit)).select(*columns)
    return documents
