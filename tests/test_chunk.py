"""Chunker (CHK1) against hand-written cases and the properties of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import chunk as CH

def check_chunks(text, chunks, max_size):
    """Nothing but white space is lost, no chunk is longer than the bound or has outer white
    space, no chunk runs past a sentence end, and no chunk could take in the next one."""
    bare = "".join((text or "").split())
    assert "".join("".join(c.split()) for c in chunks) == bare
    for c in chunks:
        assert len(c) <= max_size and c == c.strip()
        assert not any(x in c[:-1] for x in ".!?\n")
    if max_size > len(text or ""):  # whole sentences: every one but the last ends with its mark
        assert all(c[-1] in ".!?" or i == len(chunks) - 1 or "\n" in text for i, c in enumerate(chunks))


def run(spark, texts, max_size, overlap=0):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = CH.sentence_chunks(df, "text", max_size, overlap, keep=("id",)).collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk_no"])):
        got[r["id"]].append(r["chunk"])
    return [got[i] for i in range(len(texts))]


def test_reference_cases(spark):
    got = run(spark, ["", "Small.", "One. Two.", None], 10)
    assert got == [[], ["Small."], ["One.", "Two."], []]


def test_size_bound_and_terminators(spark):
    a = run(spark, ["One. Two. Three."], 8)[0]
    b = run(spark, ["First. Second. Third."], 10)[0]
    assert a and all(len(c) <= 8 for c in a)
    assert all(c[-1] in ".!?" for c in b)


@pytest.mark.parametrize("max_size,overlap", [(0, 0), (5, -1), (5, 6), (5, 5)])
def test_bad_parameters(max_size, overlap):
    with pytest.raises(ValueError):
        CH.validate_chunk_params(max_size, overlap)


def test_edge_cases(spark):
    texts = ["...", "no terminator at all", "x" * 25 + ".", "ab" + " " * 12 + "cd.", "\U0001F600 smile! ok",
             " lead and trail .　", "a\nb\n\nc"]
    assert run(spark, texts, 10) == [
        [".", ".", "."], ["no termina", "tor at all"], ["x" * 10, "x" * 10, "x" * 5 + "."], ["ab", "cd."],
        ["\U0001F600 smile!", "ok"], ["lead and t", "rail\u2003."], ["a", "b", "c"]]
    for max_size in (4, 10, 200):
        for t, chunks in zip(texts, run(spark, texts, max_size)):
            check_chunks(t, chunks, max_size)


def test_random_texts_match_rule(spark):
    rng = random.Random(7)
    alphabet = "ab .!?\n \t é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for max_size in (1, 3, 7):
        for t, chunks in zip(texts, run(spark, texts, max_size)):
            check_chunks(t, chunks, max_size)


def test_page_chunk_word_gate(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 20)), (2, " ".join(["w"] * 21)), (3, "   ")], "id long, t string")
    got = {r["id"]: r["n_words"] for r in CH.page_chunks(df, "t", keep=("id",)).collect()}
    assert got == {2: 21}
