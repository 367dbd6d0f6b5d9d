"""Duplicate detection: exact groups by hashing in Python, the name pass by the properties that
define its groups, over all pairs."""

import hashlib
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from strata.catalog import dedup as CD
from strata.functions import text as TX
from strata.operators import dedup as D
from tests.conftest import SF001


def check_groups(items, followers, t):
    """A follower has an earlier leader at ratio >= t; no two leaders reach t; an empty name is
    in no group; a leader follows nobody; the leader is the earliest that reaches the name."""
    names = dict(items)
    ratio = lambda a, b: SequenceMatcher(None, names[a], names[b]).ratio()
    leaders = [i for i, n in items if n.strip() and i not in followers]
    for i, lead in followers.items():
        reach = [x for x in leaders if x < i and ratio(x, i) >= t]
        assert reach and lead == reach[0], (i, lead, reach)
        assert names[i].strip()
    for k, a in enumerate(leaders):
        assert not any(ratio(a, b) >= t for b in leaders[k + 1:])


def clean(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "i long, v string")
    rows = df.select("i", TX.clean_filename(F.col("v")).alias("c")).collect()
    return sorted((r["i"], r["c"]) for r in rows)


def run_groups(spark, names, t):
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, file_name string")
    return {r["doc_id"]: r["leader_id"] for r in D.fuzzy_groups(df, "doc_id", "file_name", t).collect()}


def test_direction_chain_and_copies(spark):
    names = ["tide.pdf", "diet.pdf", "abcdefghij.pdf", "abcdefghiX.pdf", "abcdefghXY.pdf", "abcdefghij.pdf",
             "The (draft).pdf", "x" * 250 + ".pdf", "x" * 249 + "y.pdf", "river delta 2020.pdf", "river delta.pdf",
             "2021.pdf"]
    for t in (0.85, 0.5, 0.3, 1.0):
        items = clean(spark, names)
        check_groups(items, run_groups(spark, names, t), t)


def test_sample_file_names_match_greedy(spark):
    f = CD.files(spark, SF001).select("doc_id", "file_name").orderBy("doc_id").collect()
    items = [(f[i]["doc_id"], c) for i, c in clean(spark, [r["file_name"] for r in f])]
    for t in (0.85, 0.6):
        got = {r["doc_id"]: r["leader_id"] for r in
               D.fuzzy_groups(CD.files(spark, SF001), "doc_id", "file_name", t).collect()}
        check_groups(items, got, t)


def test_exact_groups_match_hashlib(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    groups = {}
    for r in d.collect():
        groups.setdefault(hashlib.sha256(r["text"].encode()).hexdigest(), []).append(r["doc_id"])
    expected = {h: (len(v), min(v)) for h, v in groups.items() if len(v) > 1}
    got = {r["content_hash"]: (r["group_size"], r["first_id"]) for r in D.exact_groups(d, "doc_id", "text").collect()}
    assert got == expected


def test_removal_sets(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    s = spark.createDataFrame([(3,), (4,), (4,)], "id long")
    r = D.removal_sets(e, s, "id").first()
    assert (r["removed"], r["skipped"]) == (4, 1)


def test_random_short_names_match_greedy(spark):
    import random
    rng = random.Random(11)
    names = ["".join(rng.choice("ab cde") for _ in range(rng.randint(1, 12))) + ".pdf" for _ in range(160)]
    items = clean(spark, names)
    for t in (0.9, 0.85, 0.7):
        check_groups(items, run_groups(spark, names, t), t)


def random_names(seed, n, longest):
    import random
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    out = set()
    while len(out) < n:
        s = list(" ".join(rng.choice(words) for _ in range(rng.randint(1, longest))))
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        out.add("".join(s) if "".join(s).strip() else "a")
    return sorted(out)


def test_candidates_lose_no_pair_and_common_subsequence_is_exact(spark):
    from strata.operators import names as N
    names = random_names(5, 150, 9) + ["a", "b", "ab", "q" * 400, "q" * 390 + "w" * 9, "é" * 60, "é" * 55]
    df = spark.createDataFrame(list(enumerate(names)), "rep long, clean string")
    for t in (0.95, 0.85, 0.6, 0.3):
        want = {(a, b) for b in range(len(names)) for a in range(b)
                if SequenceMatcher(None, names[a], names[b]).ratio() >= t}
        got = {(r["a"], r["b"]) for r in N.candidate_pairs(df, t).collect()}
        assert want <= got, (t, sorted(want - got)[:3])
    for a, b in list(zip(names, names[7:]))[:40]:
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        assert N.common_subsequence(a, b) == row[-1]


def test_candidates_are_few(spark):
    """At 0.85 well under 1 % of all pairs of the given names are compared, at 0.75 under 5 %."""
    from strata.operators import names as N
    names = D.distinct_names(CD.files(spark, SF001), "doc_id", "file_name").checkpoint()
    n = names.count()
    for t, most in ((0.85, 0.01), (0.75, 0.05)):
        assert N.candidate_pairs(names, t).count() <= most * n * (n - 1) / 2


def test_duplicate_report_has_names_and_ratio(spark):
    rows = [(1, "x", "River Delta 2020.pdf"), (2, "x", "Other.pdf"), (3, "y", "the river deltas.pdf"), (4, "z", "river delta.pdf")]
    df = spark.createDataFrame(rows, "doc_id long, text string, file_name string")
    got = sorted(tuple(r) for r in D.duplicate_report(df, "doc_id", "file_name", "text").collect())
    assert got == [("identical", "River Delta 2020.pdf", "Other.pdf", 1, 2, 1.0),
                   ("similar", "River Delta 2020.pdf", "river delta.pdf", 1, 4, 1.0),
                   ("similar", "River Delta 2020.pdf", "the river deltas.pdf", 1, 3,
                    SequenceMatcher(None, "river delta", "river deltas").ratio())]


def test_common_subsequence_of_many_pairs_equals_that_of_one():
    """The bound over blocks is exact on names of one or more words, and what it drops cannot reach the ratio."""
    from strata.operators import names as N
    names = random_names(8, 80, 40) + ["ab" * 64, "ab" * 63 + "c", "x" * 64, "x" * 65, "é" * 600, "é" * 560 + "a" * 30]
    a, b = N.Block(range(86), names), N.Block(range(86, 172), names[::-1])
    for t in (0.95, 0.85, 0.6):
        for x, y in ((a, b), (a, a)):
            want = {(i, j) for i, p in enumerate(x.names) for j, q in enumerate(y.names) if x is not y or i < j
                    if N.common_subsequence(p, q) >= t / 2 * (len(p) + len(q)) - N.EPS}
            got = [p for i, j in N.block_pairs(x, y, t) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_names_in_several_blocks_lose_no_pair(spark):
    from strata.operators import names as N
    names = random_names(6, 90, 9)
    df = spark.createDataFrame(list(enumerate(names)), "rep long, clean string")
    got = {(r["a"], r["b"]) for r in N.candidate_pairs(df, 0.85, block=20).collect()}
    want = {(a, b) for b in range(len(names)) for a in range(b) if SequenceMatcher(None, names[a], names[b]).ratio() >= 0.85}
    assert want <= got
    assert "MapInPandas" in N.candidate_pairs(df, 0.85)._jdf.queryExecution().toString()


def test_long_names_meet_in_small_blocks_after_their_whole_histograms(spark, monkeypatch):
    """Long names of repeated words share the first occurrences of most characters, but few whole histograms."""
    from strata.operators import names as N
    words = random_names(3, 60, 3)
    names = [w[:6] * 90 for w in words if len(w) >= 6] + ["abcd efgh " * 60, "abcd efgh " * 60 + "ij"]
    x = N.Block(range(len(names)), names)
    calls, plain = [], N.has_common_subsequence
    monkeypatch.setattr(N, "has_common_subsequence", lambda a, b, need: calls.append(1) or plain(a, b, need))
    got = {p for i, j in N.block_pairs(x, x, 0.85) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for b in range(len(names)) for a in range(b)
            if N.common_subsequence(names[a], names[b]) >= 0.425 * (len(names[a]) + len(names[b])) - N.EPS}
    assert got == want and (len(names) - 2, len(names) - 1) in want
    assert len(calls) < 0.1 * len(names) ** 2 / 2
    df = spark.createDataFrame(list(enumerate(["short name", *names])), "rep long, clean string")
    paths = []
    monkeypatch.setattr(N, "scratch_path", lambda s, n, of=N.scratch_path: paths.append(of(s, n)) or paths[-1])
    monkeypatch.setattr(N, "LONG_BLOCK", 16)
    assert N.candidate_pairs(df, 0.85).count() >= len(want)
    files = spark.read.parquet(paths[0]).groupBy(F.input_file_name()).agg(F.max("len").alias("long"), F.count("rep").alias("n"))
    assert files.where("long > 512 and n > 16").isEmpty()
