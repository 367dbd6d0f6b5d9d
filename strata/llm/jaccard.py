"""N-gram Jaccard join by set relations: skipped index blocks and derived answers.

A document's set holds the hashes of its distinct word shingles; equal sets are one node (a 128-bit
fingerprint), so copies are never compared. Tokens are counted over all documents and have one global
order: by hash, then the frequent ones by count. A set is indexed under its first
``n - ceil(t n) + 1`` tokens with their positions; two sets that link share one of these, and the first
that they share passes the size and position bounds. What only one document has comes first, so
an edited copy's shared tokens come late and are skipped by position.

*Leaders.* Every index list has a leader, the set with the token at the smallest position. Each entry
of a list is first compared with the leader alone, which gives as many pairs as there are entries.
A histogram of each set bounds the overlap; what passes is verified on the whole sets. The overlap
with the leader is the entry's computed answer.

*Skipping.* Links to leaders form components. A list whose entries are all in one component is done.
The other lists are cut into blocks by component, size and position, and pairs of blocks are skipped
as a whole if sizes, positions or the answers of their entries rule all their pairs out:
two sets with overlaps i and j with the same leader share at most min(i, j) + min(n - i, m - j).
A bitmap of each set (parity of its tokens' bins) bounds the difference of two sets from below within
the join. Pairs that remain between different components are verified, and components formed again.

No list meets in one task: lists are joined, not collected, and pairs come from components that are
still apart. No number of candidates is capped.

Defined results: a null or empty text or one without words has no shingles, links with nothing, and is
its own component (its doc_id); fewer words than a shingle are one shingle. Rows with equal sets are
one component even if doc_ids repeat; a null doc_id is never the smallest unless all ids of the
component are null. Repeated rows are kept; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import list_files, scratch_path

from .common import LOWER, small_batches, staged
from .simhash import components

SEED = 42
SHINGLE = 3
PERCENT = 90             # sets link at 100 * intersection >= PERCENT * union
WORDS = 1 << 17          # words whose hashes a worker keeps
FREQUENT = 8             # sets from which a token counts as frequent
MOST_FREQUENT = 1 << 20  # frequent tokens that tasks read, the most frequent first
KEY_BITS = 40            # of a token's hash, while tokens are counted: a clash only changes the order
RANGE_TOKENS = 4 << 20   # tokens of one range of the count
TASK_TOKENS = 1 << 20    # tokens that a task holds while it counts
BINS = 256               # of a set's histogram
SEEN = 1 << 17           # sets that a task remembers to have indexed
GROUP_WORDS = 1 << 18    # words whose shingles are hashed together
WANTED_BITS = 1 << 26    # of the filter for the documents to read again


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < WORDS:
            self[word] = h
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, shingle: int = SHINGLE):
    """For each text (UTF-8 or None) the sorted distinct 64-bit hashes of its word shingles."""
    held, total = [], 0
    for t in texts:
        ws = (t or b"").translate(LOWER).split()
        held.append(np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws)))
        total += len(ws)
        if total >= GROUP_WORDS:
            yield from _hashed(held, shingle)
            held, total = [], 0
    yield from _hashed(held, shingle)


def _texts(column, rows: int = 256):
    """The texts of an Arrow column, a few at a time as Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def _hashed(words: list[np.ndarray], shingle: int):
    def mixed(h, k):
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = _mix(x + h[i:len(x) + i])
        return x
    h = np.concatenate(words) if words else np.empty(0, np.uint64)
    x = mixed(h, shingle) if len(h) >= shingle else h[:0]  # windows across two texts are not read
    at = 0
    for w in words:
        s = x[at:at + len(w) - shingle + 1] if len(w) >= shingle else mixed(w, len(w)) if len(w) else w
        at += len(w)
        s.sort()
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def fingerprint(tokens: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(tokens.tobytes(), SEED)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n to index: none if only an equal set can link with it."""
    return 0 if 100 * n < percent * (n + 1) else n - -(-percent * n // 100) + 1


# ---- counts of tokens -----------------------------------------------------------------------

def _planes(sorted_keys: np.ndarray) -> bytes:
    """Gaps of ascending keys, byte plane by byte plane: the high planes are zeros, which compress."""
    return np.ascontiguousarray(np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8)
                                .reshape(-1, 8).T).tobytes()


def _unplaned(blob) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel())


def _counted(shingle: int, bits: int):
    """Texts -> (range, keys): the keys of a task's tokens, a blob for each of 2**bits ranges."""
    def blobs(held):
        keys = np.sort(np.concatenate(held) >> np.uint64(64 - KEY_BITS))
        part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(cut[1:], len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([_planes(keys[x:y]) for x, y in zip(cut, ends)],
                                                                        pa.binary())], names=["r", "keys"])

    def f(batches):
        held, n, seen = [], 0, set()
        for b in batches:
            for s in shingle_sets(_texts(b.column(0)), shingle):
                fp = fingerprint(s)
                if not len(s) or fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                held.append(s.copy())
                n += len(s)
                if n >= TASK_TOKENS:
                    yield from blobs(held)
                    held, n = [], 0
        if held:
            yield from blobs(held)
    return f


def _frequent_keys(least: int):
    def f(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_unplaned(x) for x in table.column("keys").to_pylist()]))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df = np.diff(np.append(at, len(keys)))
        ok = df >= least
        return pa.table({"token": keys[at[ok]].view(np.int64), "df": df[ok]})
    return f


def frequent_tokens(texts: DataFrame, shingle: int = SHINGLE) -> str:
    """Count the tokens of all texts (exact copies within a task once) and write the frequent ones, at
    most MOST_FREQUENT, with their counts; their folder. Ranges of the hash space are even, whatever
    the texts are."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, min(KEY_BITS, (size // 4 // RANGE_TOKENS).bit_length()))
    blobs = texts.mapInArrow(_counted(shingle, bits), "r long, keys binary")
    counts = staged(blobs.groupBy("r").applyInArrow(_frequent_keys(FREQUENT), "token long, df long"), "jaccard-counts")
    total, least = 0, 1 << 62
    for bits, n in counts.groupBy(F.floor(F.log2("df")).alias("b")).count().orderBy(F.desc("b")).collect():
        total += n  # at most 63 rows
        if total > MOST_FREQUENT:
            break
        least = 1 << bits
    path = scratch_path(spark, "jaccard-frequent")
    counts.where(F.col("df") >= least).coalesce(1).write.parquet(path)
    return path


@lru_cache(maxsize=1)
def _frequent(path: str):
    """(keys ascending, their places in the order by count) as a worker keeps them."""
    import pyarrow.parquet as pq
    files, names = list_files(path, ".parquet")
    t = pa.concat_tables([pq.read_table(n, filesystem=files) for n in names])
    key, df = t.column("token").to_numpy().view(np.uint64), t.column("df").to_numpy()
    order = np.argsort(key)
    place = np.empty(len(key), np.int64)
    place[np.lexsort((key, df))] = np.arange(len(key))
    return key[order], place[order]


# ---- index ------------------------------------------------------------------------------------

def index_tokens(tokens: np.ndarray, frequent, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set under which it is indexed, in the global order."""
    most = prefix_length(len(tokens), percent)
    if not most:
        return tokens[:0]
    known, place = frequent
    if not len(known):
        return tokens[:most]
    keys = tokens >> np.uint64(64 - KEY_BITS)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hot = known[at] == keys
    rare = tokens[~hot]
    if len(rare) >= most:
        return rare[:most]
    return np.concatenate([rare, tokens[hot][np.argsort(place[at[hot]], kind="stable")]])[:most]


_ROW = "doc_id long, n int, f0 long, f1 long, hist binary, bits array<long>, tokens array<long>"


def _rows(path: str, shingle: int, percent: int):
    """Documents -> size, fingerprint, histogram, bitmap and index tokens of their sets; the tokens only
    where a task meets a set for the first time."""
    def f(batches):
        frequent = _frequent(path)
        seen: set = set()
        for b in batches:
            sizes, fps, hists, bits, tokens = [], [], [], [], []
            for s in shingle_sets(_texts(b.column(1)), shingle):
                fp = fingerprint(s)
                own = s[:0]
                if fp not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(fp)
                    own = index_tokens(s, frequent, percent)
                hist = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                sizes.append(len(s))
                fps.append(fp)
                hists.append(hist.astype("<u2").tobytes() if len(s) < 1 << 16 else b"")
                bits.append(np.packbits((hist & 1).astype(np.uint8)).view("<i8"))
                tokens.append(own.astype(np.int64))  # a copy: the set itself is not kept
            halves = np.frombuffer(b"".join(fps), ">i8").astype(np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            four = np.concatenate(bits) if bits else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array(hists, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (BINS // 64), pa.int32()), pa.array(four)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "n", "f0", "f1", "hist", "bits", "tokens"])
    return f


# ---- bounds --------------------------------------------------------------------------------

def enough(overlap, n, m, percent: int):
    """Does an overlap (or a bound of it) reach the threshold for sizes n and m?"""
    return (100 + percent) * overlap.cast("long") >= percent * (n.cast("long") + m.cast("long"))


def few(difference, n, m, percent: int):
    """Can sets of sizes n and m that differ in so many tokens or more reach the threshold?"""
    return (100 + percent) * difference.cast("long") <= (100 - percent) * (n.cast("long") + m.cast("long"))


def near_sizes(n, m, percent: int):
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def first_shared(n, i, m, j, percent: int):
    """Can sets of sizes n and m link if the first token they share is at places i and j?"""
    return near_sizes(n, m, percent) & enough(1 + F.least(n - i, m - j), n, m, percent)


def derived(n, low, high, m, low2, high2):
    """The largest overlap of two sets whose overlaps with one leader lie within bounds."""
    return (F.when(high2 < low, high2 + F.least(n - low, m - high2))
            .when(high < low2, high + F.least(n - high, m - low2)).otherwise(F.least(n, m)))


# ---- verification --------------------------------------------------------------------------

def _histogram_bounds(batches):
    for b in batches:
        x, y = b.column("hist").to_pylist(), b.column("hist2").to_pylist()
        n = np.minimum(b.column("n").to_numpy(), b.column("n2").to_numpy())
        top = [int(np.minimum(np.frombuffer(p, "<u2"), np.frombuffer(q, "<u2")).sum()) if p and q else int(m)
               for p, q, m in zip(x, y, n)]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a0", "a", "b", "n", "n2")] + [pa.array(top, pa.int32())],
                                         names=["a0", "a", "b", "n", "n2", "top"])


def _overlaps(batches):
    held, arr = None, None
    for b in batches:
        got = []
        for x, y in zip(b.column("s"), b.column("s2")):
            x, y = x.as_buffer(), np.frombuffer(y.as_buffer(), "<u8")
            if held is None or not x.equals(held):  # a leader's rows come one after the other
                held, arr = x, np.frombuffer(x, "<u8")
            small, large = (arr, y) if len(arr) < len(y) else (y, arr)
            at = np.searchsorted(large, small)
            got.append(int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got, pa.int32())],
                                         names=["a", "b", "overlap"])


@lru_cache(maxsize=1)
def _wanted(path: str) -> np.ndarray:
    import pyarrow.parquet as pq
    files, names = list_files(path, ".parquet")
    bits = np.zeros(WANTED_BITS >> 3, np.uint8)
    for name in names:
        at = pq.read_table(name, filesystem=files).column("at").to_numpy()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _whole_sets(path: str, shingle: int):
    """(at, text) -> (fp, s) for the documents whose place in the filter is set."""
    def f(batches):
        bits = _wanted(path)
        for b in batches:
            at = b.column(0).to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            sets = list(shingle_sets(_texts(b.column(1)), shingle))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "s"])
    return f


def verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a0, b0, n, n2) -> (a0, a, b, n, n2) with the whole fingerprints a and b (of all sets whose
    fingerprint starts with a0 and b0), ``top`` (a bound of the overlap) and ``overlap`` (exact; null if
    the bound already rules the pair out)."""
    h = nodes.select("f0", "fp", "hist")
    bounded = (pairs.join(h.toDF("b0", "b", "hist2"), "b0").join(h.toDF("a0", "a", "hist"), "a0")
               .select("a0", "a", "b", "n", "n2", "hist", "hist2")
               .mapInArrow(_histogram_bounds, "a0 long, a binary, b binary, n int, n2 int, top int"))
    bounded = staged(bounded, "jaccard-bounded")
    open_ = bounded.where(enough(F.col("top"), F.col("n"), F.col("n2"), percent)).select("a", "b")
    wanted = open_.select(F.col("a").alias("fp")).union(open_.select("b")).distinct()
    wanted = staged(nodes.join(wanted, "fp", "left_semi").select("fp", "doc_id"), "jaccard-wanted")
    # which documents to read again: a filter of fixed size; what passes by chance falls out below
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long"))), F.lit(WANTED_BITS)).cast("int").alias("at")
    path = scratch_path(documents.sparkSession, "jaccard-filter")
    wanted.select(place).distinct().coalesce(1).write.parquet(path)
    sets = documents.select(place, "text").mapInArrow(_whole_sets(path, shingle), "fp binary, s binary")
    sets = staged(sets.join(wanted.select("fp"), "fp", "left_semi"), "jaccard-sets")
    both = (open_.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("s2")), "b")
            .join(sets.select(F.col("fp").alias("a"), "s"), "a"))
    # a set may come from several documents; its overlaps are equal
    exact = both.mapInArrow(_overlaps, "a binary, b binary, overlap int").groupBy("a", "b").agg(
        F.max("overlap").alias("overlap"))
    return staged(bounded.join(exact, ["a", "b"], "left"), "jaccard-verified")


# ---- the join ------------------------------------------------------------------------------

def _fp(f0, f1):
    return F.unhex(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def _leader_rows(index: DataFrame) -> DataFrame:
    """Entries of lists with two sets or more, each beside the leader (l0, ln, lpos) of its list. Half a
    fingerprint names a set here; should two sets share it, both are verified."""
    # most tokens have one set alone: these go before anything else is shuffled with them
    lists = index.groupBy("token").agg(F.min("f0").alias("x"), F.max("f0").alias("y")).where("x <> y").select("token")
    shared = staged(index.join(lists, "token"), "jaccard-lists")
    lead = shared.groupBy("token").agg(F.min(F.struct("pos", "n", "f0")).alias("l"))
    rows = shared.distinct().join(lead, "token")
    return staged(rows.select("token", "f0", "n", "pos", F.col("l.f0").alias("l0"), F.col("l.n").alias("ln"),
                              F.col("l.pos").alias("lpos")), "jaccard-entries")


def _apart(rows: DataFrame, first: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs between components that size, position and leaders' answers leave open."""
    answers = first.groupBy(F.col("a0").alias("l0"), F.col("b").alias("fp")).agg(
        F.min(F.coalesce("overlap", F.lit(0))).alias("low"), F.max(F.coalesce("overlap", "top")).alias("high"))
    e = (rows.where("f0 <> l0").join(nodes.select("f0", "fp", "bits"), "f0").join(labels.select("fp", "label"), "fp", "left")
         .withColumn("comp", F.xxhash64(F.coalesce("label", "fp"))).drop("label"))
    e = staged(e, "jaccard-labelled")
    open_lists = e.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    e = (e.join(open_lists, "token", "left_semi").join(answers, ["l0", "fp"], "left")
         .withColumns({"low": F.coalesce("low", F.lit(0)), "high": F.coalesce("high", F.least("n", "ln"))})
         .withColumns({"size_class": F.floor(F.log("n") * float(1 / np.log(100 / percent))) if percent < 100 else F.col("n"),
                       "place_class": F.floor(F.log2("pos"))}))
    e = staged(e.withColumn("block", F.xxhash64("token", "comp", "size_class", "place_class"))
               .select("token", "block", "comp", "f0", "n", "pos", "low", "high", "bits"), "jaccard-open")
    blocks = e.groupBy("token", "block", "comp").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("n") - F.col("low")).alias("out_low"),
        F.max(F.col("n") - F.col("high")).alias("out_high"),
        *[F.bit_and(F.col("bits")[i]).alias(f"all{i}") for i in range(BINS // 64)],
        *[F.bit_or(F.col("bits")[i]).alias(f"any{i}") for i in range(BINS // 64)])
    x, y = blocks.alias("x"), blocks.alias("y")

    def c(side, name):
        return F.col(f"{side}.{name}")

    def lone(s, t):  # the most that entries of s and t share if all answers of t are below those of s
        return c(t, "high") + F.least(c(s, "out_low"), c(t, "out_high"))
    # bits that all sets of one block have and none of the other differ in every pair of them
    apart = sum((F.bit_count(c("x", f"all{i}").bitwiseAND(F.bitwise_not(c("y", f"any{i}")))
                             .bitwiseOR(c("y", f"all{i}").bitwiseAND(F.bitwise_not(c("x", f"any{i}")))))
                 for i in range(BINS // 64)), F.lit(0))
    most = (F.when(c("y", "high") < c("x", "low"), lone("x", "y")).when(c("x", "high") < c("y", "low"), lone("y", "x"))
            .otherwise(F.least(c("x", "n1"), c("y", "n1"))))
    keep = x.join(y, (c("x", "token") == c("y", "token")) & (c("x", "comp") < c("y", "comp"))
                  & (100 * c("x", "n1") >= percent * c("y", "n0")) & (100 * c("y", "n1") >= percent * c("x", "n0"))
                  & enough(1 + F.least(c("x", "rest"), c("y", "rest")), c("x", "n0"), c("y", "n0"), percent)
                  & enough(most, c("x", "n0"), c("y", "n0"), percent)
                  & few(apart, c("x", "n1"), c("y", "n1"), percent)).select(
        c("x", "token").alias("token"), c("x", "block").alias("bx"), c("y", "block").alias("by"))
    ex = e.select("token", F.col("block").alias("bx"), F.col("f0").alias("a0"), "n", F.col("pos").alias("i"), "low", "high",
                  F.col("bits").alias("bits"))
    ey = e.select("token", F.col("block").alias("by"), F.col("f0").alias("b0"), F.col("n").alias("n2"),
                  F.col("pos").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("bits").alias("bits2"))
    pairs = keep.join(ex, ["token", "bx"]).join(ey, ["token", "by"])
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(BINS // 64)), F.lit(0))
    pairs = pairs.where(few(apart, F.col("n"), F.col("n2"), percent)
                        & first_shared(F.col("n"), F.col("i"), F.col("n2"), F.col("j"), percent)
                        & enough(derived(*(F.col(k) for k in ("n", "low", "high", "n2", "low2", "high2"))),
                                 F.col("n"), F.col("n2"), percent))
    turn = F.col("a0") > F.col("b0")  # a pair may come up in either direction
    return pairs.select(F.least("a0", "b0").alias("a0"), F.greatest("a0", "b0").alias("b0"),
                        F.when(turn, F.col("n2")).otherwise(F.col("n")).alias("n"),
                        F.when(turn, F.col("n")).otherwise(F.col("n2")).alias("n2")).distinct()


def similar_sets(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT):
    """(rows, labels): rows (doc_id, n, fp) of every document, and (fp, label) of every set that links
    with another one; equal labels are one component."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    with small_batches(documents.sparkSession):  # every job with Python runs within
        return _linked(documents, shingle, percent)


def _linked(documents: DataFrame, shingle: int, percent: int):
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    path = frequent_tokens(src.select("text"), shingle)
    rows = staged(src.mapInArrow(_rows(path, shingle, percent), _ROW), "jaccard-rows")
    fp = _fp(F.col("f0"), F.col("f1")).alias("fp")
    nodes = staged(rows.where("n > 0").groupBy("f0", "f1").agg(F.min("doc_id").alias("doc_id"), F.first("hist").alias("hist"),
                                                              F.first("bits").alias("bits"))
                   .select("f0", fp, "doc_id", "hist", "bits"), "jaccard-nodes")
    index = rows.select("f0", "n", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    entries = _leader_rows(index)
    to_leaders = entries.where("f0 <> l0").where(first_shared(F.col("ln"), F.col("lpos"), F.col("n"), F.col("pos"), percent))
    pairs = staged(to_leaders.select(F.col("l0").alias("a0"), F.col("f0").alias("b0"), F.col("ln").alias("n"),
                                     F.col("n").alias("n2")).distinct(), "jaccard-leaders")
    first = verified(src, nodes, pairs, shingle, percent)
    links = first.where(enough(F.col("overlap"), F.col("n"), F.col("n2"), percent)).select("a", "b")
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rest = staged(_apart(entries, first, labels, nodes, percent), "jaccard-pairs")
    second = verified(src, nodes, rest, shingle, percent)
    more = second.where(enough(F.col("overlap"), F.col("n"), F.col("n2"), percent)).select("a", "b")
    links = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return rows.select("doc_id", "n", fp), components(links)


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows, labels = similar_sets(documents, shingle, percent)
    firsts = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    named = firsts.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = staged(named, "jaccard-named")
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    groups = named.join(ids, "label").select("fp", "component_id")
    return rows.join(groups, "fp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
