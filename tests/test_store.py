"""Store ingest idempotence, state tables and the file-size gate."""

import tempfile

from pyspark.sql import functions as F

from strata import constants as K
from strata.operators import store as ST
from strata.schemas import MESSAGE, STORE_DOCUMENTS, STORE_VECTORS
from strata.sources import files as SF


def tmp():
    return tempfile.mkdtemp(prefix="strata-test-")


def test_ingest_twice_keeps_one_copy_and_vectors(spark):
    root = tmp()
    chunks = spark.createDataFrame([("a.pdf", 0, "Rivers transport sediment."), ("a.pdf", 1, "Rivers transport sediment."),
                                    ("b.pdf", 0, "Climate drives rainfall."), ("b.pdf", 1, "   ")],
                                   "source string, chunk_no int, chunk string")
    rows = ST.chunk_rows(chunks)
    ST.ingest(spark, root, rows)
    ST.ingest(spark, root, rows)
    docs = ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)
    vecs = ST.read_table(spark, f"{root}/embeddings", STORE_VECTORS)
    assert docs.count() == 3 and vecs.count() == 3                      # blank chunk dropped, no duplicates
    assert docs.join(vecs, "id", "left_anti").count() == 0              # every document has its vector
    assert {r["embedding_type"] for r in docs.collect()} == {K.DEFAULT_SUMMARY_TYPE}


def test_ingest_repairs_missing_vectors(spark):
    root = tmp()
    chunks = spark.createDataFrame([("a.pdf", 0, "one two")], "source string, chunk_no int, chunk string")
    rows = ST.chunk_rows(chunks)
    rows.select(*[c.name for c in STORE_DOCUMENTS.fields]).write.parquet(f"{root}/documents/batch=0")  # died
    ST.ingest(spark, root, rows)
    assert ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS).count() == 1
    assert ST.read_table(spark, f"{root}/embeddings", STORE_VECTORS).count() == 1


def test_batches_replace_themselves_and_known_sources_are_left_out(spark):
    root = tmp()
    rows = lambda *xs: ST.chunk_rows(spark.createDataFrame(xs, "source string, chunk_no int, chunk string"))
    a, b = ("a.pdf", 0, "one two"), ("b.pdf", 0, "three")
    ST.ingest(spark, root, rows(a, b, b), batch="x")                    # a row that comes twice
    ST.ingest(spark, root, rows(a, ("c.pdf", 0, "four")), batch="y")    # a.pdf is known
    ST.ingest(spark, root, rows(("b.pdf", 0, "three, corrected")), batch="x")  # batch x again: replaced as a whole
    docs = ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)
    assert sorted(r["content"] for r in docs.collect()) == ["four", "three, corrected"]
    vecs = ST.read_vectors(spark, root, K.DEFAULT_SUMMARY_TYPE)
    assert sorted(r["source"] for r in vecs.collect()) == ["b.pdf", "c.pdf"]
    assert ST.read_vectors(spark, root, "other").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_shuffles_neither_texts_nor_vectors_and_a_type_is_pruned(spark, monkeypatch):
    root, plans = tmp(), []
    write = ST._replace
    monkeypatch.setattr(ST, "_replace", lambda df, path, *by: (plans.append((path, plan(df))), write(df, path, *by)))
    rows = ST.chunk_rows(spark.createDataFrame([("a.pdf", 0, "one two")], "source string, chunk_no int, chunk string"))
    ST.ingest(spark, root, rows, batch="x")
    ST.ingest(spark, root, rows, batch="y")  # with the join on known sources
    assert len(plans) == 6
    for path, p in plans:
        if not path.endswith("sources"):
            assert "hashpartitioning" not in p and "RoundRobin" not in p, p
    scan = plan(ST.read_vectors(spark, root, "finding"))
    assert "PartitionFilters: [isnotnull(embedding_type" in scan and "finding" in scan


def test_missing_store_is_empty(spark):
    assert ST.read_table(spark, f"{tmp()}/nothing", STORE_DOCUMENTS).count() == 0
    assert ST.read_progress(spark, None).count() == 0
    assert ST.read_progress(spark, f"{tmp()}/none").count() == 0
    assert ST.upsert_progress(spark, None, spark.createDataFrame([("a", 1)], "source string, chunks_processed long")) is None


def test_progress_last_write_wins(spark):
    root = tmp()
    ST.upsert_progress(spark, root, spark.createDataFrame([("a", 1), ("b", 2)], "source string, chunks_processed long"))
    ST.upsert_progress(spark, root, spark.createDataFrame([("b", 5), ("c", 3)], "source string, chunks_processed long"))
    assert {r["source"]: r["chunks_processed"] for r in ST.read_progress(spark, root).collect()} == {"a": 1, "b": 5, "c": 3}


def test_history_append_trim_clear(spark):
    root = tmp()
    m = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(12)], MESSAGE)
    ST.append_history(spark, root, m, MESSAGE)
    got = ST.read_state(spark, root, MESSAGE)
    assert sorted(r["turn"] for r in got.collect()) == list(range(2, 12))      # last 10 kept
    ST.clear_history(spark, root, MESSAGE)
    assert ST.read_state(spark, root, MESSAGE).count() == 0


def test_size_gate_boundaries(spark):
    df = spark.createDataFrame([(1048,), (1049,), (104857600,), (104857601,), (None,)], "length long")
    valid, reason = SF.size_gate("length")
    got = [(r["valid"], r["reason"]) for r in df.select(valid, reason).collect()]
    assert got == [(False, "too_small"), (True, None), (True, None), (False, "too_large"), (False, "missing")]


def test_pending_and_retry(spark):
    s = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(2,)], "id long")
    assert sorted(r["id"] for r in ST.pending(s, done, "id").collect()) == [1, 3]
    assert ST.pending(s, done, "id", retry_failed=True).count() == 3
