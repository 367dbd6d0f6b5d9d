"""N-gram Jaccard join against brute force over the shingles themselves."""

import random

import pytest

from strata.llm import jaccard
from strata.llm.common import LOWER

from .conftest import SCHEMA, rows


def shingles(text, k=3):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(pairs, percent=90):
    sets = [shingles(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(map(repr, ((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(pairs))))


def found(df, **kw):
    return sorted(map(repr, map(tuple, jaccard.jaccard_components(df, **kw).collect())))


def test_equals_brute_force_on_documents_and_edges(documents, edge):
    docs = documents.select("doc_id", "text").unionAll(edge.select("doc_id", "text"))
    assert found(docs) == brute([tuple(r) for r in docs.collect()])


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        at = rng.randrange(len(w))
        w[at:at + rng.choice([0, 1, 1])] = [f"x{rng.randrange(10 ** 9)}"]
    return " ".join(w)


@pytest.mark.parametrize("percent", [90, 70])
def test_equals_brute_force_on_chains_shared_passages_and_hot_groups(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = random.Random(percent)
    texts = []
    shared = [f"s{i}" for i in range(60)]
    for size in (9, 11, 20, 60, 200):
        base = [f"b{size}_{i}" for i in range(size)]
        texts += [edited(rng, base, rng.randrange(0, max(2, size // 12))) for _ in range(60)]
        for _ in range(15):  # a chain: every link changes a little more
            base = edited(rng, base, max(1, size // 60)).split()
            texts.append(" ".join(base))
        texts += [" ".join(shared + [f"u{rng.randrange(10 ** 9)}" for _ in range(size)]) for _ in range(10)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    texts += [texts[7]] * 3 + [texts[100].upper(), None, "", " \t"]
    pairs = [(rng.randrange(10 ** 6), t) for t in texts]
    pairs += [(None, texts[3]), (None, "no id " * 4), pairs[5], pairs[5], (pairs[9][0], "an id twice, another text")]
    df = spark.createDataFrame(rows(pairs), SCHEMA).repartition(5)
    assert found(df, percent=percent) == brute(pairs, percent)


def test_few_frequent_tokens_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    pairs = [(i, edited(rng, base, rng.randrange(0, 8))) for i in range(80)]
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    want = brute(pairs)
    assert found(df) == want
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 0)
    assert found(df) == want


def test_empty_table_and_long_text(spark, none):
    assert jaccard.jaccard_components(none).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.jaccard_components(none).count() == 0
    long = " ".join(f"t{i}" for i in range(70000))
    df = spark.createDataFrame(rows([(4, long), (2, long + " end"), (3, long[:1000])]), SCHEMA)
    assert found(df) == sorted(map(repr, [(4, 69998, 2), (2, 69999, 2), (3, len(shingles(long[:1000])), 3)]))


def test_session_settings_stay(spark, documents):
    before = dict(spark.conf.getAll)
    jaccard.jaccard_components(documents.limit(20)).count()
    assert dict(spark.conf.getAll) == before


def test_index_length_and_percent():
    assert [jaccard.prefix_length(n) for n in (0, 1, 8, 9, 10, 100)] == [0, 0, 0, 1, 2, 11]
    with pytest.raises(ValueError):
        jaccard.similar_sets(None, percent=0)
