"""SimHash near-dedup and suffix-array dedup."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from strata.llm import simhash, suffix
from strata.llm.common import LOWER


def fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, ids):
    a, up = np.array(prints, np.uint64), list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= 2)[0].tolist():
            x, y = sorted((root(i), root(j)))
            up[y] = x
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(documents, edge):
    docs = documents.select("doc_id", "text").unionAll(edge.select("doc_id", "text"))
    given = docs.collect()
    prints = [fingerprint(r.text) for r in given]
    want = sorted(map(repr, zip([r.doc_id for r in given], [f"{x:016x}" for x in prints],
                                components(prints, [r.doc_id for r in given]))))
    got = sorted(repr(tuple(r)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_gray_index_finds_all_pairs_of_a_dense_ball():
    rng = np.random.default_rng(1)
    ball = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    f = np.unique(np.concatenate([rng.integers(0, 2**63, 2000, dtype=np.uint64), ball]))
    rank = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    f = f[np.argsort(rank)]
    got = {p for i, j in simhash._search(f, f, 2, 256) for p in zip(i.tolist(), j.tolist())}
    assert got == set(map(tuple, np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2).tolist()))


def test_chains_across_blocks_are_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (1 << k))
    rows = spark.createDataFrame([(100 + i, x) for i, x in enumerate(chain)] + [(7, -1)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_groups(rows).collect()}
    assert got == {**{x: 100 for x in chain}, -1: 7}


def test_one_document_of_each_group_stays(edge, none):
    left = simhash.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    assert ids == [(False, i) for i in (1, 4, 5, 6, 7, 8)] + [(True, 0)]
    assert simhash.drop_near_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def removed(rows):
    """Brute force over all 50-byte strings."""
    texts = [((1 << 62) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(i, first.get(s, i))
    for (i, b), (doc_id, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        yield doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_equals_brute_force(spark, documents, edge, monkeypatch):
    for name, value in (("SHARD_ROWS", 20), ("PIECE", 20000), ("RANGE_BYTES", 40000)):
        monkeypatch.setattr(suffix, name, value)
    p = "abcdefghij" * 12
    made = [(9001, "x" * 49), (9002, "x" * 50), (9003, "yy" + "x" * 60 + "zz" + "x" * 50), (9005, p),
            (9006, p[3:60] + "Q" + p[1:52] + "é" * 30), (9007, "é" * 40), (None, p), (9005, p)]
    docs = (documents.select("doc_id", "text").where("doc_id < 120").unionAll(edge.select("doc_id", "text"))
            .unionAll(spark.createDataFrame(made, "doc_id long, text string")))
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(repr(tuple(r)) for r in suffix.dedup_spans(docs.repartition(4)).collect())
    assert got == sorted(map(repr, removed(rows)))


def test_stretches_that_agree_in_half_their_hash_are_different(monkeypatch):
    """All rounds on shards of one document; stretch hashes differ in their upper half only."""
    plain = suffix.Piece.anchors
    monkeypatch.setattr(suffix.Piece, "anchors", lambda self: (
        lambda f: f and (*f[:3], f[3] << np.uint64(32)))(plain(self)))
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in (70, *[40] * 12)]
    rows = [(i, words[1 + 2 * i] + words[0] + words[2 + 2 * i]) for i in range(6)]
    docs = [pa.table({"shard": [i], "row": [0], "doc_id": [i], "id": [i], "text": [t.encode()]}) for i, t in rows]

    def of(table, column, value):
        return table.filter(pc.equal(table[column], value))
    own = pa.concat_tables([suffix._reports(1)(d) for d in docs])
    asked = suffix._meet(of(own, "kind", suffix.ANCHORS))
    sent = pa.concat_tables([suffix._send(1)(d, of(asked, "shard", i)) for i, d in enumerate(docs)])
    late = of(sent, "kind", suffix.STRETCHES)
    gone = pa.concat_tables([of(own, "kind", suffix.RUNS), of(sent, "kind", suffix.RUNS),
                             suffix._settle(late) if late.num_rows else late])
    got = [r for i, d in enumerate(docs) for r in suffix._cut(d, of(gone, "shard", i)).to_pylist()]
    assert [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]),
             hashlib.sha256(r["kept"]).hexdigest()) for r in got] == list(removed(rows))


def test_kept_bytes_and_removed_spans_are_returned(spark):
    p = "abcdefghij" * 3 + "0123456789" * 3
    rows = [(1, p), (2, "A" + p + "é" + p[5:] + "B"), (3, None), (4, "é" * 25), (5, "x" + "é" * 25)]
    out = suffix.kept_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out.collect()}
    assert got == {1: (60, [], p.encode()), 2: (119, [(1, 61), (63, 118)], "AéB".encode()), 3: (0, [], b""),
                   4: (50, [], ("é" * 25).encode()), 5: (51, [(1, 51)], b"x")}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 7, 800):
        t = rng.integers(97, 100, n).astype(np.uint8)
        t[n // 2:n // 2 + n // 4] = t[:n // 4]
        w, b = suffix.words8(t), t.tobytes()
        sa = suffix.suffix_array(t, w)
        keys = [(b[i:i + 64] + b"\xff" * 64)[:64] for i in sa]
        assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(n))
        lcp = suffix.common_prefixes(w, sa)
        for i in range(1, n):
            x, y = b[sa[i]:], b[sa[i - 1]:]
            m = next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert lcp[sa[i]] == m


def test_suffix_dedup_of_nothing(none):
    assert suffix.dedup_spans(none).count() == 0
