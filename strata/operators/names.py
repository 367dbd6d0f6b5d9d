"""Similar names (JOI4): all that can reach the ratio, by bounds over blocks of names.

The ratio of two names is ``2*M/(la+lb)``, M the characters in difflib's matching blocks, which
are common substrings in order. If it reaches t, M is at least ``t*(la+lb)/2``. M is at most

* the multiset intersection of the characters (and so the shorter length), and
* the longest common subsequence.

With 15 % of the characters free to differ no key is shared by similar names only: a join on rare
characters writes a part of all pairs that does not fall with the number of names, and its rows cost
far more than the bounds. So names are written once to the shared folder in blocks, sorted by
length; a task takes pairs of blocks whose lengths can meet, and holds no more than them:

* the intersections of two blocks are one matrix product: the k-th character of a bin is a bit, so
  the common bits of two names count it (of characters without a bit at most as many as either
  name has are added). A float holds 24 bits exactly, so the bits of several names lie in one number as
  fields, each of which starts so high that its top bit tells whether the bound is reached;
* of the pairs that are left, those with characters that have no bit (long names) are compared by
  their whole histograms;
* the rest, some in a hundred, go through the bit-parallel common subsequence all at once, a character
  of every pair in each step, in the words around the diagonal only: a place further off leaves too few
  characters before or behind. A pair is dropped when the characters to come, as many in both names,
  cannot reach the bound: pairs that are not similar end after some two fifths of their length.
  Names of more than 64 * WORDS characters take it one pair at a time, and lie in small blocks of their own:
  their pairs cost a thousand times as much, and a large block would give one task millions of them.

The work grows with the square of the number of names of about one length; what is shuffled are pairs of
block names and the few candidates. Of these Python computes the ratio: the common subsequence on the
whole alphabet first, and only then difflib.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

EPS = 1e-2                # below a bound, for its rounding; what is bounded are whole numbers
BINS, DEPTH = 36, 24      # character bins, and the occurrences of one that have a bit
EXACT_BITS = 24           # of a float32
BLOCK = 4096              # names of a block at most
BLOCKS = 32               # a class of lengths has so many blocks at least, if each has LEAST_BLOCK names
LEAST_BLOCK = 512
MEDIUM = 128              # names of more characters lie in blocks of half the size
LONG_BLOCK = 128          # names of more than 64 * WORDS characters of a block
TILE = 512                # names of a block that meet the other at once
PAIRS = 1 << 14           # pairs whose common subsequence is computed at once
CHECKS = 12               # times that pairs out of reach are looked for in the length of a name
SELDOM = 64               # a bit that is used by a smaller share of a block's names is not compared one by one
CODES = 128               # characters that the subsequence tells apart: ASCII, others by remainder
WORDS = 8                 # 64-bit integers of a name; of longer ones Python computes the subsequence

# clean names hold lower-case letters, digits, '_' and ' ' of ASCII; other characters share the codes of the rest
_FREE = np.array([c for c in range(CODES) if not (chr(c).isalnum() and not chr(c).isupper() or chr(c) in "_ ")])


# ---- exact ratio ----------------------------------------------------------------------------

_MASKS: dict = {}
_MASKS_CHARS = 4_000_000


def _masks(s: str) -> dict:
    """For each character of ``s`` the integer whose bits are its places; kept for later pairs."""
    m = _MASKS.get(s)
    if m is None:
        if _MASKS.get("", 0) > _MASKS_CHARS:
            _MASKS.clear()
        m = {}
        for i, ch in enumerate(s):
            m[ch] = m.get(ch, 0) | 1 << i
        _MASKS[s] = m
        _MASKS[""] = _MASKS.get("", 0) + len(s)
    return m


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one pass over ``b`` with integers of len(a) bits."""
    if not a or not b:
        return 0
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def has_common_subsequence(a: str, b: str, need: float) -> bool:
    """Whether the longest common subsequence has ``need`` characters at least; stops when those to come are too few
    (see :func:`_reaching`)."""
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    if need > min(len(a), len(b)):
        return False
    for k, ch in enumerate(b):
        if not k & 63:
            place = max(len(a) - len(b) + k, 0)
            if place - (v & (1 << place) - 1).bit_count() + len(b) - k < need:
                return False
        m = masks.get(ch)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count() >= need


def ratio_at_least(a: str, b: str, t: float):
    """difflib's ratio (a first) when it reaches t, else None. Bounds are tested in the same
    2.0*M/L arithmetic that difflib uses, so rounding cannot lose a pair."""
    n = len(a) + len(b)
    if n == 0 or 2.0 * min(len(a), len(b)) / n < t or 2.0 * common_subsequence(a, b) / n < t:
        return None
    r = SequenceMatcher(None, a, b).ratio()
    return r if r >= t else None


def name_ratio(t: float):
    """Arrow-batched ratio UDF. Marked non-deterministic only so that Catalyst does not
    copy the filter on its result below the projection, which would run difflib twice."""
    @F.pandas_udf(T.DoubleType())
    def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_at_least(x, y, t) for x, y in zip(a, b)], dtype="float64")
    return _ratio.asNondeterministic()


# ---- bounds over two blocks ----------------------------------------------------------------------

class Block:
    """Names (rep, clean) as arrays: lengths, character counts and bits, characters as codes, places by character."""

    def __init__(self, reps, names):
        self.reps, self.names = np.asarray(reps, np.int64), names
        self.len = np.fromiter(map(len, names), np.int64, len(names))
        row, flat = np.repeat(np.arange(len(names)), self.len), np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        counts = np.bincount(row * BINS + flat % BINS, minlength=len(names) * BINS).reshape(-1, BINS)
        bits = (np.arange(DEPTH) < counts[:, :, None]).reshape(len(names), -1)
        self.used = np.flatnonzero(bits.sum(axis=0) * SELDOM >= len(names))
        self.bits = bits.astype(np.float32)
        self.rest = self.len - bits[:, self.used].sum(axis=1)  # characters without a bit in use
        self.other = np.maximum(counts - DEPTH, 0).sum(axis=1)
        self.counts = counts.astype(np.int32)
        self.place = np.arange(len(flat)) - np.repeat(np.cumsum(self.len) - self.len, self.len)
        self.row, self.code = row, np.where(flat < CODES, flat, _FREE[flat % len(_FREE)]).astype(np.int64)
        self._packed: dict = {}

    def packed(self, cols: slice, width: int):
        """(bit and one, field): the bits in use of the names ``cols``, several names in fields of ``width`` binary
        digits of a float32; name ``f * columns + c`` of them lies in field f of column c."""
        kept = self._packed.get(cols.start)
        if kept is None or kept[0] != width:
            fields = EXACT_BITS // width
            bits = self.bits[cols, self.used].T
            columns = -(-bits.shape[1] // fields)
            out = np.zeros((len(bits) + 1, columns), np.float32)
            for f in range(fields):
                part = bits[:, f * columns:(f + 1) * columns]
                out[:-1, :part.shape[1]] += part * np.float32(1 << width * f)
                out[-1, :part.shape[1]] += np.float32(1 << width * f)
            self._packed[cols.start] = kept = (width, out)
        return kept[1]

    @property
    def texts(self):
        """(place, name): codes of the characters, CODES where a name has ended."""
        if not hasattr(self, "_texts"):
            out = np.full((int(self.len.max(initial=0)), len(self.names)), CODES, np.int64)
            out[self.place, self.row] = self.code
            self._texts = out
        return self._texts

    @property
    def masks(self):
        """(words, name, code): the bits of the places at which a name of at most 64 * WORDS characters has a code."""
        if not hasattr(self, "_masks"):
            short = self.len[self.len <= 64 * WORDS]
            out = np.zeros((-(-int(short.max(initial=1)) // 64), len(self.names), CODES + 1), np.uint64)
            ok = self.len[self.row] <= 64 * WORDS
            place = self.place[ok]
            np.bitwise_or.at(out, (place // 64, self.row[ok], self.code[ok]), np.uint64(1) << (place % 64).astype(np.uint64))
            self._masks = out
        return self._masks


def sharing(x: Block, y: Block, rows: slice, t: float):
    """Pairs (i, j) of ``x[rows]`` and ``y`` that share as many characters as the ratio t needs."""
    lens, bits = x.len[rows], x.bits[rows][:, y.used]
    rest = lens - bits.sum(axis=1).astype(np.int64)  # shared are as many of these at most as either name has
    bits, pairs = np.column_stack([bits, bits[:, :1]]), []
    for at in range(0, len(y.len), TILE):  # of about one length, so that the shortest tells what is needed
        cols = slice(at, min(at + TILE, len(y.len)))
        ylen, yrest = y.len[cols], y.rest[cols]
        # what a row needs at least of the characters that have a bit in use
        least = np.ceil(t / 2 * (lens + int(ylen.min())) - EPS) - np.minimum(rest, int(yrest.max()))
        least = np.maximum(least, 1).astype(np.int64)
        # a field holds half its range more than the common bits beyond those, so its top bit tells
        width = int(max(least.max(), min(lens.max(), ylen.max()))).bit_length() + 1
        if width > EXACT_BITS:
            raise ValueError("a name is too long")
        half, fields = 1 << width - 1, EXACT_BITS // width
        bits[:, -1] = half - least
        got = (bits @ y.packed(cols, width)).astype(np.int32)
        hits = np.flatnonzero(got & np.int32(sum(half << width * f for f in range(fields))))
        if not len(hits):
            continue
        row, column = np.divmod(hits, got.shape[1])
        value = got.ravel()[hits]
        for f in range(fields):
            on = np.flatnonzero(value & np.int32(half << width * f))
            i, j = row[on], f * got.shape[1] + column[on]
            shared = (value[on] >> width * f & half - 1) + least[i] + np.minimum(rest[i], yrest[j])
            ok = np.flatnonzero(shared >= np.maximum(t / 2 * (lens[i] + ylen[j]) - EPS, 0.5))
            pairs.append((i[ok] + rows.start, j[ok] + at))
    i, j = zip(*pairs) if pairs else ([np.empty(0, np.int64)],) * 2
    return np.concatenate(i), np.concatenate(j)


def counted(x: Block, y: Block, i, j, t: float):
    """The pairs (i, j) of :func:`sharing` whose whole histograms, where bits do not tell all, reach the ratio t."""
    keep = np.ones(len(i), bool)
    over = np.flatnonzero((x.other[i] > 0) & (y.other[j] > 0))
    for at in range(0, len(over), PAIRS):
        part = over[at:at + PAIRS]
        shared = np.minimum(x.counts[i[part]], y.counts[j[part]]).sum(axis=1)
        keep[part] = shared >= t / 2 * (x.len[i[part]] + y.len[j[part]]) - EPS
    return i[keep], j[keep]


def in_order(x: Block, y: Block, i, j, t: float):
    """Which of the pairs (i, j), ``x``'s name of at most 64 * WORDS characters, can have a common subsequence
    as long as t needs."""
    keep = np.zeros(len(i), bool)
    words = -(-x.len[i] // 64)
    for w in np.unique(words):
        mine = np.flatnonzero(words == w)
        for at in range(0, len(mine), PAIRS):
            part = mine[at:at + PAIRS]
            keep[part[_reaching(x, y, i[part], j[part], int(w), t)]] = True
    return keep


def _found(v, place):
    """The length of the common subsequence in the first ``place`` characters of each name: the bits that are not set."""
    one, found = np.uint64(1), np.zeros(len(place), np.int64)
    for w, bits in enumerate(v):
        rest = np.minimum(np.maximum(place - 64 * w, 0), 64).astype(np.uint64)
        own = (one << (rest >> one) << (rest - (rest >> one))) - one  # a shift by 64 is undefined
        found += np.bitwise_count(~bits & own)
    return found


def _reaching(x: Block, y: Block, i, j, words: int, t: float):
    """Which pairs can reach the ratio t by their common subsequence. With M common characters no place p of a name
    meets a place k of the other with ``p - k > la - M`` or ``k - p > lb - M``, so words beyond that are not begun yet
    or done. After k characters the rest is ``lb - k`` at most, of the places behind ``la - lb + k`` the same number: what is
    found before that place and the rest bound the whole, since a place more finds one character more at most."""
    la, lb, text = x.len[i], y.len[j], y.texts
    need = np.ceil(t / 2 * (la + lb) - EPS).astype(np.int64)
    ahead, behind = int((la - need).max()), int((lb - need).max())
    masks, first = [m.ravel() for m in x.masks[:words]], i * (CODES + 1)
    v, left = [], np.arange(len(i))
    longest = int(lb.max())
    check, step = int((lb - need).min()) + 1, max(2, longest // CHECKS)  # none is out of reach before
    for k in range(longest):
        if k == check and k:
            check += step
            ok = _found(v, np.minimum(la - lb + k, la)) + np.maximum(lb - k, 0) >= need
            n = np.count_nonzero(ok)
            if not n:
                return left[:0]
            if n < 0.9 * len(ok):
                ok = np.flatnonzero(ok)
                first, j, la, lb, need, left = (c.take(ok) for c in (first, j, la, lb, need, left))
                v = [w.take(ok) for w in v]
        while len(v) < min(words, max(k + ahead, 0) // 64 + 1):
            v.append(np.full(len(left), ~np.uint64(0)))
        place, carry = first + text[k].take(j), None
        for w in range(min(max(k - behind, 0) // 64, words), len(v)):
            u = v[w] & masks[w].take(place)
            s = v[w] + u
            if len(v) > 1:
                over = s < u
                if carry is not None:
                    s += carry
                    over |= s < carry
                carry = over.view(np.uint8)
            v[w] = s | (v[w] - u)
    return left[_found(v, la) >= need]


def block_pairs(x: Block, y: Block, t: float):
    """Pieces (i, j) with the pairs of two blocks, or of one (i < j), that may reach t."""
    for at in range(0, len(x.len), TILE):
        i, j = sharing(x, y, slice(at, min(at + TILE, len(x.len))), t)
        if x is y:
            i, j = i[i < j], j[i < j]
        short = x.len[i] <= 64 * WORDS
        if not short.all():
            i, j = counted(x, y, i, j, t)
            short = x.len[i] <= 64 * WORDS
        keep = np.zeros(len(i), bool)
        keep[short] = in_order(x, y, i[short], j[short], t)
        for p in np.flatnonzero(~short):
            a, b = x.names[i[p]], y.names[j[p]]
            keep[p] = has_common_subsequence(a, b, t / 2 * (len(a) + len(b)) - EPS)
        if keep.any():
            yield i[keep], j[keep]


# ---- candidates --------------------------------------------------------------------------------

def _kernel(path: str, t: float):
    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(path)

        @lru_cache(maxsize=4)
        def block(name):
            got = pq.read_table(f"{root}/{name}", filesystem=files, columns=["rep", "clean"])
            return Block(got.column("rep").to_numpy(), got.column("clean").to_pylist())

        for pdf in batches:
            for first, second in sorted(zip(pdf["x"], pdf["y"])):
                x, y = block(first), block(second)
                for i, j in block_pairs(x, y, t):
                    a, b = x.reps[i], y.reps[j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def candidate_pairs(names: DataFrame, t: float, block: int = BLOCK) -> DataFrame:
    """(a, b, name_a, name_b) with rep a < rep b for names (rep, clean) that may reach ratio t.

    No pair that reaches t is lost, and no pair that fails a bound is written."""
    spark = names.sparkSession
    name = names.select("rep", "clean")
    path = scratch_path(spark, "name-blocks")
    n, longer = name.agg(F.count(F.lit(1)), F.count_if(F.length("clean") > 64 * WORDS)).first()
    length = F.length("clean")
    medium = name.where(length > MEDIUM).count() - longer
    full = []  # blocks of each class of lengths
    for part, rows, most in ((length.between(1, MEDIUM), n - medium - longer, block),
                             (length.between(MEDIUM + 1, 64 * WORDS), medium, -(-block // 2)),
                             (length > 64 * WORDS, longer, min(block, LONG_BLOCK))):
        size = min(most, max(LEAST_BLOCK, -(-rows // BLOCKS)))
        full.append(-(-rows // size))
        (name.where(part).withColumn("len", length)
             .repartitionByRange(max(1, full[-1]), "len", "rep").sortWithinPartitions("len")
             .write.mode("append").option("maxRecordsPerFile", size).parquet(path))
    blocks = (spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
              .agg(F.min("len").alias("low"), F.max("len").alias("high")))
    x, y = (blocks.select(*[F.col(c).alias(f"{s}{c}") for c in ("file", "low", "high")]) for s in "xy")
    reach = F.lit((2 - t) / t)
    meet = ((F.col("xfile") <= F.col("yfile")) & (F.col("xhigh") * reach + EPS >= F.col("ylow"))
            & (F.col("yhigh") * reach + EPS >= F.col("xlow")))
    # one row for each pair of blocks, dealt out so that neighbours, alike in length, come to different tasks
    todo = x.join(y, meet).select(F.col("xfile").alias("x"), F.col("yfile").alias("y"))
    tasks = max(spark.sparkContext.defaultParallelism * 4, sum(full))
    pairs = todo.repartition(tasks, "x", "y").mapInPandas(_kernel(path, t), "a long, b long")
    return (pairs.join(name.select(F.col("rep").alias("a"), F.col("clean").alias("name_a")), "a")
            .join(name.select(F.col("rep").alias("b"), F.col("clean").alias("name_b")), "b")
            .select("a", "b", "name_a", "name_b"))
