"""Hard-negative mining against brute force over Python integers."""

import math

import numpy as np
import pytest

from strata.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, aid string, P int"


def brute(rows, every=100):
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab, *_ in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = float("inf")

    def by(score):
        return sorted(score, key=lambda x: (-x[0], last if x[1] is None else x[1]))
    out = []
    for ai, alab, a in ok:
        if ai is None or ai % every:
            continue
        dots = [(sum(x * y for x, y in zip(a, v)), i, lab) for i, lab, v in ok if len(v) == len(a)]
        for ps, pi, _ in by([d for d in dots if d[2] == alab and d[1] != ai])[:5]:
            good = by([d for d in dots if d[2] != alab and 30 * ps <= 100 * d[0] <= 90 * ps])[:10]
            out += [(ai, pi, n, ni, ps, s) for n, (s, ni, _) in enumerate(good, 1)]
    return sorted(out, key=repr)


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(df).collect()), key=repr)


def test_windows_over_many_tiles(monkeypatch):
    monkeypatch.setattr(negatives, "FIRST_ROWS", 16)
    monkeypatch.setattr(negatives, "TILE_ROWS", 40)
    rng = np.random.default_rng(4)
    rows, anchors = (rng.integers(-3, 4, (n, 6)).astype(float) for n in (500, 4))
    owner, low, high = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([-5., 2, 0, 9, 9, -99, 3]), np.array([20., 2, 7, 8, 12, 99, 30])
    scores = (anchors @ rows.T).astype(int)
    even = np.arange(500) % 2 == 0
    want = []
    for w, a in enumerate(owner):
        ok = np.flatnonzero((scores[a] >= low[w]) & (scores[a] <= high[w]) & even)
        want += [(w, scores[a, r], r) for r in sorted(ok, key=lambda r: (-scores[a, r], r))[:5]]
    for most in (3, 1 << 22):  # two or more fields, and one
        got = negatives.search(negatives.Packed(rows, most), anchors, owner, low, high, lambda ai, ri: even[ri], 5)
        assert [tuple(map(int, x)) for x in zip(*got)] == [tuple(map(int, x)) for x in want]
    got = negatives.search_wide(negatives.Packed(rows, 3, 8), negatives.unbounded(anchors), owner, low.astype(object),
                                high.astype(object), lambda ai, ri: even[ri], 5)
    assert [tuple(map(int, x)) for x in zip(*got)] == [tuple(map(int, x)) for x in want]


def test_equals_brute_force_with_edges_and_ties(spark):
    rng = np.random.default_rng(5)
    few = (rng.integers(-2, 3, (12, 8)) / 4).tolist()  # many equal scores
    rows = [(i, few[rng.integers(12)], int(rng.integers(3)), "x", 1) for i in range(0, 700, 3)]
    rows += [(100 * i, rng.normal(size=8).tolist(), int(rng.integers(3)), "x", 1) for i in range(1, 6)]
    rows += [(7, None, 1, "x", 1), (8, [1.0] * 8, None, "x", 1), (100, [None] + [1.0] * 7, 1, "x", 1),
             (200, [float("nan")] * 8, 1, "x", 1), (9, [float("inf")] * 8, 1, "x", 1), (None, few[0], 0, "x", 1),
             (None, few[1], 1, "x", 1), (300, [], 0, "x", 1), (301, [], 0, "x", 1), (302, [], 1, "x", 1),
             (400, [0.5], 0, "x", 1), (401, [0.7], 0, "x", 1), (402, [0.4], 2, "x", 1), (600, [0.0] * 8, 0, "x", 1),
             rows[0], rows[5], rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mined(df.repartition(3))
    assert got == brute(rows) and len(got) > 300
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_components_beyond_a_double_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10 ** rng.integers(0, 6)).astype(np.float32).tolist(), i % 3, "x", 1)
            for i in range(0, 500, 4)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and got
    far = rows + [(4, [3e38, -3e38, 1.0], 0, "x", 1), (500, [3e38, 1.0, 2.0], 0, "x", 1)]
    assert len(mined(spark.createDataFrame(far, SCHEMA))) >= 1  # scores saturate, nothing fails


@pytest.mark.parametrize("most,dim", [(1, 1), (3, 64), (256, 64), (40000, 16), (1 << 20, 512)])
def test_packed_fields_unpack_to_exact_products(most, dim):
    rng = np.random.default_rng(most)
    a, b = (rng.integers(-most, most + 1, (n, dim)).astype(float) for n in (5, 23))
    a[0], b[0], a[1], b[1] = most, most, -most, -most
    want = (a.astype(int) @ b.astype(int).T).tolist()
    p = negatives.Packed(b, most)
    assert p.fields > 1 if most <= 256 else p.fields == 1
    assert p.scores(a, 0, 23).astype(int).tolist() == want
    wide = negatives.Packed(b, most, 8)
    assert wide.scores(negatives.unbounded(a), 0, 23).tolist() == want
