"""The encoder, its model slot and pooling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import encode as EN
from strata.operators import pooling as P


def test_encoder_flushes_keep_every_count(monkeypatch):
    texts = ["", None, "a b A_1 été", "x " * 501, "Ünï-code 12", "y"] + [f"w{i} z" for i in range(40)]
    want = EN.encode_matrix(texts, 16)
    monkeypatch.setattr(EN, "FLUSH_TOKENS", 7)
    got = EN.encode_matrix(texts, 16)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    assert want[0].sum(axis=1).tolist()[:6] == [0, 0, 4, 501, 3, 1] and want[1].tolist()[:3] == [False, True, False]
    row = np.bincount([EN.token_bucket(t, 16) for t in ("ünï", "code", "12")], minlength=16)
    assert got[0][4].tolist() == row.tolist()


def test_encoder_holds_no_more_for_longer_texts(monkeypatch):
    held = []
    count = np.bincount
    monkeypatch.setattr(EN.np, "bincount", lambda x, **kw: (held.append(len(x)), count(x, **kw))[1])
    EN.encode_matrix(["a " * 300000, "b"], 8)
    assert sum(held) == 300001 and max(held) <= EN.FLUSH_TOKENS


def test_encoder_cuts_a_batch_at_once_as_each_text_alone(monkeypatch):
    """Short texts are cut together: nulls, NULs, letters that grow in lower case and words at both ends stay their own."""
    texts = ["Ab", None, "ab", "", "x\0y", "\0", "İstanbul ΣΑΣ", "ΟΔΟΣ", "Σ", "²½ Ⅷ_𝟘 \u4e00-\u0307e", "a\u00adb", "\U00010400 z"] * 30
    want = np.zeros((len(texts), 16))
    for r, t in enumerate(texts):
        for token in EN._FIND((t or "").lower()):
            want[r, EN.token_bucket(token.group(), 16)] += 1
    matches = []
    find = EN._FIND
    EN._word_chars()
    monkeypatch.setattr(EN, "_FIND", lambda t: (matches.append(t), find(t))[1])
    got, nulls = EN.encode_matrix(texts, 16)
    assert np.array_equal(got, want) and nulls.tolist() == [t is None for t in texts]
    assert not matches  # no text was gone through match by match


def test_model_slot_batches_and_lets_nulls_through(spark):
    def make():
        def predict(texts):
            assert len(texts) <= 4 and all(isinstance(t, str) for t in texts)
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])
        return predict
    df = spark.createDataFrame([(i, "a" * i) for i in range(9)] + [(9, None), (10, "")], "i long, t string")
    enc = EN.model_encoder(make, 3, batch_size=4)
    got = {r["i"]: r["v"] for r in df.select("i", enc(F.col("t")).alias("v")).collect()}
    assert got[9] is None and got[5] == [5.0, 5.0, 1.0] and got[10] == [0.0, 0.0, 1.0]
    assert {r["i"]: r["embedding"] for r in EN.encode(df, "t", encoder=enc).collect()}[3] == [3.0, 3.0, 1.0]
    with pytest.raises(Exception, match="not of length 5"):
        df.select(EN.model_encoder(make, 5, batch_size=4)(F.col("t"))).collect()


def test_pooling_zero_masks_lengths_and_nulls(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0), ("c", [1.0], 1),
            ("c", [3.0, 7.0], 1), ("c", None, 1), (None, [4.0, 4.0], 2)]
    df = spark.createDataFrame(rows, "k string, v array<double>, m int")
    got = {(r["k"], r["dim"]): r["value"] for r in P.masked_mean(df, "k", "v", "m").collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 4.0, ("b", 0): None, ("b", 1): None, ("c", 0): 2.0, ("c", 1): 7.0,
                   (None, 0): 4.0, (None, 1): 4.0}
    mean = {r["k"]: r["embedding"] for r in P.group_mean(df.where("k <> 'c'"), "k", "v").collect()}
    assert mean.keys() == {"a", "b"} and mean["a"] == pytest.approx([13 / 3, 17 / 3]) and mean["b"] == [5.0, 5.0]
    plan = P.group_mean(df, "k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
