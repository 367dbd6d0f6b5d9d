"""Token counts, packing, training order, language-model scores, the pipeline."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import feistel, packing, ppm, tokencount
from strata.llm.tokenize import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def docs(documents, edge):
    return documents.select("doc_id", "text").unionAll(edge.select("doc_id", "text"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, edge, none, library, monkeypatch):
    want = sorted(repr((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text)),
                        len(ids_of(library, r.text)) > 2048)) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in tokencount.token_counts(docs).collect()) == want
    assert tokencount.token_counts(edge).count() == edge.count()
    assert tokencount.token_counts(none).count() == 0


def test_chunk_maps_compose_at_any_cut(library, monkeypatch):
    counter = tokencount.TokenCounter()
    text = "  It's a <|endoftext|>x\x1cy unbelievable 12345 Straße ﬁ é\u0301 日本語 tiontionthe  "
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(tokencount, "CHUNK", size)
        assert counter.text(text) == len(ids_of(library, text))


def test_packing_is_gapless_whole_and_close_to_the_bound(docs, none, library):
    out = packing.packed(docs).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = collections.defaultdict(list)
    for r in docs.collect():
        ids = np.array([*ids_of(library, r.text), 1], "<u4")
        want[r.doc_id] += [(k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes()))
                           for k, a in enumerate(range(0, len(ids), 4096))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for v in places.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in out)
    assert len(places) <= 1.02 * math.ceil(total / 4096) + 1
    assert packing.packed(none).count() == 0


def test_sequences_can_be_put_together_from_the_packed_ids(spark, library):
    import corpus_pipeline
    texts = {1: "one two three " * 700, 2: "four", 3: None, 4: "five six " * 2500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    sequences, back = collections.defaultdict(dict), collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id][r.offset] = bytes(r.ids)
    whole = {s: np.frombuffer(b"".join(v[k] for k in sorted(v)), "<u4").tolist() for s, v in sequences.items()}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        back[r.doc_id] += whole[r.sequence_id][r.offset:r.offset + r.length]
    assert back == {i: [*ids_of(library, t), 1] for i, t in texts.items()}


def test_plan_equals_sequential_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 33, 60).tolist(), reverse=True)
        gaps = []
        for s in sizes:
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps[gaps.index(min(fit))] -= s
            else:
                gaps.append(32 - s)
        runs = packing.plan(dict(collections.Counter(sizes)), 32)
        used = {first + i // per for _, n, _, first, per, _ in runs for i in range(n)}
        assert len(used) == len(gaps)
        assert sum(n for _, n, *_ in runs) == len(sizes)


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 5, 1000, 4097):
        a, b = feistel.permute(np.arange(n), n, 7), feistel.permute(np.arange(n), n, 8)
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert (a != b).any()


def test_training_order_round_trip(docs, none, library):
    out = feistel.training_order(docs).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    want = []
    for r in docs.collect():
        ids = np.array([*ids_of(library, r.text), 1], "<u2")
        want += [repr((r.doc_id, k, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes())))
                 for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(repr((r.doc_id, r.piece, r.length, r.ids_crc32)) for r in out) == sorted(want)
    assert feistel.training_order(none).count() == 0


def test_reading_resumes_at_any_slot_and_leaves_settings_alone(spark, documents):
    from strata.session import scratch_path
    folder = scratch_path(spark, "resume-test")
    feistel.materialise(documents.limit(40), folder, seq_len=64, per_shard=16)
    before = dict(spark.conf.getAll)
    every = sorted(map(tuple, feistel.read_shards(spark, folder, 64, 16).collect()))
    assert [r[0] for r in every] == list(range(len(every))) and len(every) > 50
    for start in (1, 16, 37, len(every) - 1, len(every), 10 ** 6):
        assert sorted(map(tuple, feistel.read_shards(spark, folder, 64, 16, start=start).collect())) == every[start:]
    assert dict(spark.conf.getAll) == before


def test_clashing_columns_change_nothing(spark, documents):
    docs = documents.limit(30)
    clash = docs.withColumns({"kept": F.lit(True), "_row": F.lit(7), "slot": F.lit(1), "piece": F.lit("x"), "R": F.lit(2.0)})
    order = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert order(feistel.training_order(clash)) == order(feistel.training_order(docs))
    assert order(ppm.scores(clash)) == order(ppm.scores(docs))
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert order(packing.packed(clash).select(same)) == order(packing.packed(docs).select(same))


def test_ppm_equals_brute_force(docs, none):
    out = ppm.scores(docs).collect()
    texts = [(r.doc_id, (r.text or "").encode().translate(ppm.LOWER)) for r in docs.collect()]
    words, context = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, t in texts:
        if not ppm.is_held_out(i):
            words.update([*t.split(), None])
            s = b"\xfe" * 5 + t + b"\xff"
            for j in range(5, len(s)):
                for k in range(6):
                    context[s[j - k:j]][s[j]] += 1
    n, v = sum(words.values()), len(words)

    def log10(s, j):
        total, seen = 0.0, set()
        for k in range(5, -1, -1):
            c = {y: m for y, m in context.get(s[j - k:j], {}).items() if y not in seen}
            if s[j] in c:
                return total + math.log10(c[s[j]] / (sum(c.values()) + len(c)))
            if c:
                total += math.log10(len(c) / (sum(c.values()) + len(c)))
            seen |= set(c)
        return total - math.log10(256 - len(seen))
    rows = collections.defaultdict(list)
    for r in out:
        rows[r.doc_id].append(r)
    assert len(out) == len(texts)
    for i, t in texts:
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        near = [r for r in rows[i] if abs(r.base_score - base) < 1e-6 * max(1, -base)]
        assert near and near[0].train_tokens == n and near[0].held_out == ppm.is_held_out(i)
        assert (near[0].n_tokens, near[0].n_known) == (len(tokens), sum(words[w] > 0 for w in tokens))
        if len(t) < 2500:
            s = b"\xfe" * 5 + t + b"\xff"
            assert abs(near[0].score - sum(log10(s, j) for j in range(5, len(s)))) < 1e-6 * len(s)
    assert ppm.scores(none).count() == 0


def test_pipeline_stages(spark, documents):
    import corpus_pipeline
    docs = documents
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if stage is not corpus_pipeline.best_fit_packing:
            assert out.columns == documents.columns
        from strata.llm.common import staged
        docs = staged(out, "test-stage")
        seen[name] = docs.count()
    counts = list(seen.values())
    assert documents.count() > counts[0] >= counts[1] > counts[2] == counts[3] <= counts[4]


def test_pipeline_stages_on_null_long_and_repeated_texts_and_on_nothing(spark, edge, none):
    import corpus_pipeline
    from strata.llm.common import staged
    from tests.conftest import SF001
    for docs in (edge, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF001), "edge-" + name.replace(" ", "-"))
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        assert "sequence_id" in docs.columns
    assert docs.count() == 0


def test_encoder_equals_the_library():
    from strata.llm.tokenize import Encoder
    enc = Encoder()
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    odd = [s.format(c) for c in letters for s in ("{0}", "a{0}", "{0}1", "Z{0}{0}x'S")]
    odd += ["don't it's 'RE'", "a1b2 3", "x<|endoftext|>y <|endoftext|>", "İa Å é ﬁ", "漢字",
            "a\x1cb c", "", " ", "word " * 3000, "%%%," * 50, "ÀÉŸž, ×÷"]
    for text, ids in zip(odd, enc.encode(odd), strict=True):
        assert ids.tolist() == enc.library.encode(text, add_special_tokens=False).ids, text


def test_encoder_learns_pieces_and_cuts_texts_in_groups(monkeypatch):
    from strata.llm import tokenize
    enc = tokenize.Encoder()
    enc.encode(["Alpha, ALPHA. (alpha) Él's 'll 42", None, "  ", "漢字 x<|y alpha"])
    assert set(enc.pieces) == {b"alpha", b",", b".", b"(", b")", "él".encode(), b"'s", b"'ll", b"4", b"2", "漢字".encode(), b"x<|y"}
    monkeypatch.setattr(tokenize, "GROUP", 20)
    monkeypatch.setattr(tokenize, "KEPT_PIECES", 5)
    texts = [f"w{n} It'S {n}' d x ''ve\tÀ{n}" * (n % 4) for n in range(50)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == enc.library.encode(text, add_special_tokens=False).ids, text


def test_training_order_in_passes_leaves_no_shuffle_behind(docs, library, spark, tmp_path):
    """Each pass shuffles its own shards, the manifest has all, and records are those of one pass."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, found = spark.conf.get(key), []
    for passes in (1, 4):
        feistel.PASSES, was = passes, feistel.PASSES
        try:
            folder = str(tmp_path / f"p{passes}")
            manifest = feistel.materialise(docs, folder, seq_len=64, per_shard=50).collect()
        finally:
            feistel.PASSES = was
        got = sorted(tuple(r) for r in feistel.read_shards(spark, folder, 64, 50).drop("doc_id", "piece").collect())
        assert sorted(r.shard for r in manifest) == list(range(-(-len(got) // 50))) and sum(r.slots for r in manifest) == len(got)
        assert [r[0] for r in got] == list(range(len(got)))
        found.append(sorted(r[1:] for r in got))
    assert found[0] == found[1] and spark.conf.get(key) == before


def test_shuffle_files_of_a_finished_query_are_removed(spark, tmp_path):
    import os

    from strata.llm.common import shuffle_files_removed
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {f for d in disk.localDirs() for _, _, names in os.walk(d.getPath()) for f in names if f.endswith(".data")}
    query = spark.range(1000).repartition(4, "id")
    query.write.parquet(str(tmp_path / "kept"))
    before = shuffled()
    assert before
    with shuffle_files_removed(spark):
        spark.range(1000).repartition(5, "id").write.parquet(str(tmp_path / "removed"))
    assert shuffled() <= before
