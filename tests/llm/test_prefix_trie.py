"""Conversation prefix trie against a trie built turn by turn."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from strata.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, size int, Node string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        size = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids[node])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()),
                  key=repr)


def found(df, **sizes):
    return sorted(map(tuple, prefix_trie.conversation_trie(df, **sizes).collect()), key=repr)


def conversations(rng, n, texts, longest):
    rows = []
    for c in rng.sample(range(-150, 600), n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts), 1, "x")
                 for t in range(rng.randrange(1, longest))]
    return rows


def test_equals_a_trie_built_turn_by_turn(spark):
    rng = random.Random(1)
    rows = conversations(rng, 250, ["a", "bé😀", "", None], 14)
    rows += [(7, None, "user", "first", 1, "x"), (7, 3, None, None, 1, "x"), (7, 3, None, None, 1, "x"),
             (None, 1, "user", "nobody", 1, "x"), (700, 1, "", "z", 1, "x"), rows[3], rows[3],
             (8, 2, "user", "tie one", 1, "x"), (8, 2, "user", "tie two", 1, "x"), (9, 1, "user", "w" * 100000, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df) == brute(rows)


@pytest.mark.parametrize("block,span,fan", [(2, 4, 2), (4, 8, 3)])
def test_long_copied_and_hot_conversations(spark, block, span, fan):
    rng = random.Random(2)
    long = [("user", f"turn {i}") for i in range(90)]
    rows = [(c, i, r, t, 1, "x") for c in (100, 5, 300, 17) for i, (r, t) in enumerate(long[:90 - c % 7])]
    rows += [(c, i, "user", "same", 1, "x") for c in range(2000, 2300) for i in range(9)]  # copies
    rows += [(3000, i, "user", f"hot {i}", 1, "x") for i in range(400)]                     # one long one
    rows += conversations(rng, 60, ["a", "b"], 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(7)
        assert found(df, block=block, span=span, fan=fan, piece=8) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_conversations_without_turns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    lone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1][:2]
    rows = [(c, 1, "user", "dropped: it stands before the cut", 1, "x") for c in lone]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert len(brute(rows)) == 1  # the root alone


def test_given_table(given):
    df = given("conversations")
    assert found(df) == brute([tuple(r) for r in df.collect()])
