"""Structured Streaming jobs: many micro-batches, replays, versions and known sources."""

import os

from strata.operators import store as ST
from strata.schemas import MESSAGE, STORE_DOCUMENTS
from strata.streaming import jobs as SJ

DOCS = "doc_id long, text string, source string"


def messages(spark, *rows):
    return spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], MESSAGE).coalesce(1)


def test_history_over_small_micro_batches_keeps_one_live_version(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    for k in range(4):  # a file each; the smallest limit takes one file a micro-batch
        SJ.land(messages(spark, *[(c, 10 * k + t, f"{c}-{k}-{t}") for c in (1, 2) for t in range(3)]), land)
    SJ.stream_history(spark, land, out, 4, batch_bytes=1)
    got = sorted((r["conv_id"], r["turn"], r["text"]) for r in SJ.latest_history(spark, out).collect())
    assert got == [(c, t, f"{c}-{t // 10}-{t % 10}") for c in (1, 2) for t in (22, 30, 31, 32)]
    assert sorted(x for x in os.listdir(out) if x.startswith("v=")) == ["v=2", "v=3"]
    SJ.land(messages(spark, (1, 32, "said again"), (3, 0, "new")), land)
    SJ.stream_history(spark, land, out, 4)
    got = {(r["conv_id"], r["turn"]): r["text"] for r in SJ.latest_history(spark, out).collect()}
    assert len(got) == 9 and got[(1, 32)] == "said again" and got[(2, 32)] == "2-3-2" and got[(3, 0)] == "new"


def test_a_replayed_batch_starts_from_the_version_before(spark, tmp_path):
    root = str(tmp_path / "state")
    for version, turns in ((0, [1]), (1, [1, 2]), (1, [1, 2, 3])):
        old = ST.read_state(spark, root, MESSAGE, before=version)
        assert sorted(r["turn"] for r in old.collect()) == ([] if version == 0 else [1])
        ST.write_state(spark, root, messages(spark, *[(1, t, "x") for t in turns]), version=version)
    assert ST.read_state(spark, root, MESSAGE).count() == 3
    ST.drop_versions(spark, root, 99)
    assert os.listdir(root) == ["v=1"]


def test_ingest_takes_only_new_files_and_unknown_sources(spark, tmp_path):
    land, root = str(tmp_path / "land"), str(tmp_path / "store")
    docs = lambda *rows: spark.createDataFrame(rows, DOCS).coalesce(1)
    SJ.land(docs((1, "One. Two.", "a")), land)
    SJ.land(docs((2, "Three.", "a")), land)
    SJ.stream_ingest(spark, land, docs((0, "", "")).schema, root, 200, 0, batch_bytes=1)
    SJ.land(docs((1, "Changed.", "a"), (3, "Four.", None), (4, "Five.", "b")), land)
    SJ.stream_ingest(spark, land, docs((0, "", "")).schema, root, 200, 0)
    rows = ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS).collect()
    assert sorted((r["source"] or "", r["content"]) for r in rows) == [
        ("", "Four."), ("a/1.pdf", "One."), ("a/1.pdf", "Two."), ("a/2.pdf", "Three."), ("b/4.pdf", "Five.")]
    assert ST.read_vectors(spark, root).count() == 5
    assert sorted(x for x in os.listdir(f"{root}/documents") if x.startswith("batch")) == [
        "batch=stream-0", "batch=stream-1", "batch=stream-2"]
