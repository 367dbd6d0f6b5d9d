"""Hard-negative mining with Kronecker-packed products.

Scores are integer inner products of quantised vectors. The components of several candidates are
biased to be non-negative and put side by side, as bit fields, into one wide integer per
component position; one multiplication with an anchor's (biased) component then advances the
scores of all of them, and after the last component every field holds one candidate's sum, which is
cut out and freed of the biases. No field can run over into the next: its width is that of the
largest possible sum. The wide integers live in the 53 bits that a double holds exactly, so the
multiplications of a tile are one matrix product and still exact; rows or anchors whose
components are too large for that (:func:`narrow_limit`) take the same path over Python's
unbounded integers, a few rows at a time.

Anchors are written once to the shared folder as files of bounded size and read by the tasks; a task
holds a chunk of rows of bounded size, in id order, and meets block after block. What leaves a chunk
is at most k rows for each anchor and window, found against the k-th best so far; Spark ranks
these. Two passes: positives first (the same label), then the negatives within the score window of
each distinct positive score (at most ``positives`` windows an anchor).

Defined results: rows with a null label or vector, or a component that is null, not finite or not
finite once scaled, take no part; neither do rows of another vector length than the anchor's. A row
with the anchor's own id is not another row, so copies of an anchor are no positives; repeated
anchor rows are anchors of their own (their result rows repeat), repeated other rows count each. A
null id is no anchor and comes last among ties. Scores beyond 64 bits are returned as the nearest
long. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import list_files, scratch_path

from .common import staged

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90           # the window of a negative, in per cent of the positive's score
BLOCK_BYTES = 16 << 20       # anchor vectors of one file
CHUNK_BYTES = 64 << 20       # vectors of rows that a task holds at once
TILE_ANCHORS, TILE_ROWS, FIRST_ROWS = 256, 8192, 512
EXACT_BITS = 53              # integers that a double holds
LONG = (1 << 63) - 1


def narrow_limit(dim: int) -> int:
    """The largest |component| for which one biased sum of ``dim`` products fits in a double."""
    return int(((1 << EXACT_BITS) / max(1, dim)) ** 0.5) // 2 - 1


def matrix(vec: pa.Array, dim: int, scale: int = SCALE):
    """(floor(scale * x) as integral doubles, row places) of the vectors of length ``dim`` whose
    components are all finite."""
    at = vec.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(at) == dim) & ~vec.is_null().to_numpy(zero_copy_only=False))
    values = vec.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        got = np.floor(values[at[rows][:, None] + np.arange(dim)].astype(np.float64) * scale)
    ok = np.isfinite(got).all(axis=1)
    return got[ok], rows[ok]


def unbounded(mat: np.ndarray) -> np.ndarray:
    """The same integers as Python's, which have no largest value."""
    return np.array([[int(x) for x in r] for r in mat], object).reshape(mat.shape)


class Packed:
    """Rows packed for anchors with |component| <= ``most``: ``fields`` rows to a wide integer."""

    def __init__(self, rows: np.ndarray, most: int, fields: int | None = None):
        n, self.dim = rows.shape
        self.bias = int(max(-rows.min(initial=0), rows.max(initial=0)))
        self.most = most
        # a biased component is at most twice its bias, and at least one bit wide
        self.width = max(1, (max(1, self.dim) * (2 * most + 1) * (2 * self.bias + 1)).bit_length())
        self.wide = fields is not None
        self.fields = fields or max(1, EXACT_BITS // self.width)
        self.rows = unbounded(rows) if self.wide else rows
        self.sums = self.rows.sum(axis=1)

    def scores(self, anchors: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact inner products (anchors x rows[a:b])."""
        part = self.rows[a:b]
        lane = -(-len(part) // self.fields)
        packed = 0
        for f in range(self.fields):  # the rows of a lane become one bit field
            own = part[f * lane:(f + 1) * lane] + self.bias
            if len(own) < lane:
                own = np.concatenate([own, np.zeros((lane - len(own), self.dim), own.dtype)])
            packed = packed + own * (1 << (self.width * f))
        product = (anchors + self.most).dot(packed.T)
        out = [None] * self.fields
        for f in range(self.fields - 1, -1, -1):
            if self.wide:
                out[f] = product >> (self.width * f)
            else:
                out[f] = np.floor(product * 2.0 ** (-self.width * f))
            product = product - out[f] * (1 << (self.width * f))
        got = np.concatenate(out, axis=1)[:, :len(part)]
        own = anchors.sum(axis=1) * self.bias + self.dim * self.most * self.bias
        return got - own[:, None] - (self.sums[a:b] * self.most)[None, :]


def best(w, s, r, k: int):
    """The k best (score descending, row ascending) entries of each window, and their places."""
    order = np.lexsort((r, -s, w))
    ws = w[order]
    start = np.concatenate([[True], ws[1:] != ws[:-1]])
    place = np.arange(len(ws)) - np.maximum.accumulate(np.where(start, np.arange(len(ws)), 0))
    keep = order[place < k]
    return w[keep], s[keep], r[keep], place[place < k]


def search(packed: Packed, anchors: np.ndarray, owner, low, high, allowed, k: int):
    """(window, score, row) of the k best rows with low <= score <= high for each window.

    Window i belongs to anchor ``owner[i]`` (ascending, each anchor has one at least); of equal
    scores the earlier row wins. ``allowed(anchor places, rows)`` says which pairs count."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    many = np.diff(np.append(first, len(owner)))
    ceiling = np.maximum.reduceat(high, first)
    floor = low.copy()  # the least score that can still enter a window
    held = (np.empty(0, np.int64), np.empty(0, low.dtype), np.empty(0, np.int64))
    a = 0
    while a < len(packed.rows):
        b = a + (FIRST_ROWS if a == 0 else TILE_ROWS)
        s = packed.scores(anchors, a, b)
        lowest = np.minimum.reduceat(floor, first)
        ai, ri = np.nonzero((s >= lowest[:, None]) & (s <= ceiling[:, None]))
        ok = allowed(ai, ri + a)
        ai, ri = ai[ok], ri[ok]
        sc, ri = s[ai, ri], ri + a
        n = many[ai]  # one entry for each window of the anchor
        at = np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(first[ai], n) + np.arange(len(at)) - at
        sc, ri = np.repeat(sc, n), np.repeat(ri, n)
        ok = (sc >= floor[w]) & (sc <= high[w])
        if ok.any():
            new = (w[ok], sc[ok], ri[ok])
            *held, place = best(*(np.concatenate(x) for x in zip(held, new)), k)
            full = place == k - 1
            floor[held[0][full]] = held[1][full] + 1  # later rows have later ids: a tie loses
        a = b
    return held


def _blocks(df: DataFrame, name: str) -> str:
    """Write anchors (aid, id, label, vec, windows) as files of bounded size; their folder."""
    path = scratch_path(df.sparkSession, name)
    size = df.agg(F.sum(8 * F.size("vec").cast("long"))).first()[0] or 0
    df.repartition(max(1, -(-size // BLOCK_BYTES))).write.parquet(path)
    return path


def _kernel(path: str, k: int, same: bool, scale: int):
    """Rows (id, label, vec) -> the best rows of each window: (aid, p, id, score)."""

    def pieces(held):
        """Rows or anchors by class: those that fit in doubles, and the others."""
        mat, at = held
        wide = (np.abs(mat) > narrow_limit(mat.shape[1])).any(axis=1)
        return [(w, mat[m], at[m]) for w, m in ((False, ~wide), (True, wide)) if m.any()]

    def run(batches):
        import pyarrow.parquet as pq
        files, names = list_files(path, ".parquet")

        @lru_cache(maxsize=1)  # a single block is read once in a task
        def block(name):
            t = pq.read_table(name, filesystem=files).combine_chunks()
            vec = t.column("vec").combine_chunks()
            return t, [(dim, x) for dim in pc.unique(pc.list_value_length(vec)).to_pylist()
                       for x in pieces(matrix(vec, dim, scale))]

        def chunks():
            held, size = [], 0
            for rb in batches:
                held.append(rb)
                size += rb.column(2).nbytes
                if size >= CHUNK_BYTES:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for chunk in chunks():
            chunk = chunk.take(pc.sort_indices(chunk.column(0), null_placement="at_end"))
            ids, labels, vec = (pa.concat_arrays(c.chunks) for c in chunk.columns)
            label_of = labels.to_numpy()
            id_of, no_id = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            stored = lru_cache(maxsize=4)(lambda dim: pieces(matrix(vec, dim, scale)))
            for name in names:
                t, parts = block(name)
                for dim, (aw, amat, aat) in parts:
                    for rw, rmat, rat in stored(dim):
                        wide = aw or rw
                        most = int(np.abs(amat).max(initial=0))
                        packed = Packed(rmat, most, 8 if wide else None)
                        for x in range(0, len(aat), TILE_ANCHORS):
                            yield from answers(t, packed, amat[x:x + TILE_ANCHORS], aat[x:x + TILE_ANCHORS],
                                               rat, ids, label_of, id_of, no_id, wide)

    def answers(t, packed, amat, aat, rat, ids, label_of, id_of, no_id, wide):
        part = t.take(pa.array(aat))
        a_label, a_id = part.column("label").to_numpy(), part.column("id").to_numpy()
        windows = [w or [{"p": 0, "low": -np.inf, "high": np.inf}] for w in part.column("windows").to_pylist()]
        flat = [w for ws in windows for w in ws]
        owner = np.repeat(np.arange(len(aat)), [len(ws) for ws in windows])
        low, high = (np.array([w[c] for w in flat], object if wide else np.float64) for c in ("low", "high"))

        def allowed(ai, ri):
            rows = rat[ri]
            if same:
                return (label_of[rows] == a_label[ai]) & ((id_of[rows] != a_id[ai]) | no_id[rows])
            return label_of[rows] != a_label[ai]
        if wide:
            w, s, r = search_wide(packed, unbounded(amat), owner, low, high, allowed, k)
        else:
            w, s, r = search(packed, amat, owner, low, high, allowed, k)
        if len(w):
            yield pa.RecordBatch.from_arrays(
                [part.column("aid").combine_chunks().take(pa.array(owner[w])),
                 pa.array([flat[i]["p"] for i in w], pa.int64()), ids.take(pa.array(rat[r])),
                 pa.array([max(-LONG - 1, min(LONG, int(x))) for x in s], pa.int64())],
                names=["aid", "p", "id", "score"])
    return run


def search_wide(packed: Packed, anchors, owner, low, high, allowed, k: int, step: int = 64):
    """What :func:`search` does, over Python integers of any size."""
    kept: dict[int, list] = {i: [] for i in range(len(owner))}
    for a in range(0, len(packed.rows), step):
        s = packed.scores(anchors, a, a + step)
        ai, ri = (x.ravel() for x in np.indices(s.shape))
        ok = allowed(ai, ri + a).reshape(s.shape)
        for i, o in enumerate(owner.tolist()):
            new = [(-x, a + j) for j, x in enumerate(s[o]) if ok[o, j] and low[i] <= x <= high[i]]
            kept[i] = sorted(kept[i] + new)[:k]
    flat = [(i, -x, r) for i, xs in kept.items() for x, r in xs]
    return (np.array([f[0] for f in flat], np.int64), [f[1] for f in flat], np.array([f[2] for f in flat], np.int64))


_OUT = "aid long, p long, id long, score long"


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """For rows (vec_id, embedding, label): every anchor (vec_id divisible by ``every``), its first
    ``positives`` other rows of its label and, for each, the first ``negatives`` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    src = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                      F.col("embedding").alias("vec")).where("label is not null and vec is not null")
    anchors = staged(src.where(F.col("id") % every == 0)
                     .withColumn("aid", F.monotonically_increasing_id()), "negatives-anchors")
    anywhere = F.expr("cast(null as array<struct<p: long, low: long, high: long>>)")
    path = _blocks(anchors.withColumn("windows", anywhere), "negatives-anchor-blocks")
    order = F.desc("score"), F.asc_nulls_last("id")
    near = (src.mapInArrow(_kernel(path, positives, True, scale), _OUT)
            .withColumn("place", F.row_number().over(Window.partitionBy("aid").orderBy(*order)))
            .where(F.col("place") <= positives))
    near = staged(near.select("aid", F.col("id").alias("positive_id"), F.col("score").alias("p")), "negatives-positives")
    # a negative window for each distinct positive score; one below zero admits none
    exact = F.col("p").cast("decimal(20,0)")
    bounds = near.where("p >= 0").select("aid", "p", F.ceil(exact * low / 100).cast("long").alias("low"),
                                         F.floor(exact * high / 100).cast("long").alias("high"))
    windows = bounds.groupBy("aid").agg(F.array_sort(F.collect_set(F.struct("p", "low", "high"))).alias("windows"))
    path = _blocks(anchors.join(windows, "aid"), "negatives-window-blocks")
    found = (src.mapInArrow(_kernel(path, negatives, False, scale), _OUT)
             .withColumn("rank", F.row_number().over(Window.partitionBy("aid", "p").orderBy(*order)))
             .where(F.col("rank") <= negatives))
    pairs = near.join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
    return pairs.join(found, ["aid", "p"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"),
        F.col("score").alias("negative_score"))
