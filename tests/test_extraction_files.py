"""One file a source: names, line numbers, replaced files, failed tasks."""

import os

import pytest
from pyspark.sql import functions as F

from strata.sources import extraction_files as EF
from strata.sources import files as SF


def lines(spark, *rows):
    return spark.createDataFrame(rows, "stem string, n int, line string").repartition(3)


def read(spark, path):
    return sorted(tuple(r) for r in EF.read_lines(spark, path).collect())


def test_files_lines_and_replacement(spark, tmp_path):
    path = str(tmp_path / "out")
    EF.write_files(lines(spark, ("a", 2, "second é"), ("a", 1, "first"), ("b", 1, "  "), ("b", 2, "x"), (None, 1, "?")),
                   path, order_col="n")
    assert sorted(os.listdir(path)) == ["_SUCCESS", "_attempts", "a_gemini.jsonl", "b_gemini.jsonl", "unnamed_gemini.jsonl"]
    assert os.listdir(f"{path}/_attempts") == []
    assert read(spark, path) == [("a_gemini.jsonl", 1, "first"), ("a_gemini.jsonl", 2, "second é"),
                                 ("b_gemini.jsonl", 2, "x"), ("unnamed_gemini.jsonl", 1, "?")]
    EF.write_files(lines(spark, ("a", 1, "new")), path, order_col="n")
    (tmp_path / "out" / "other.jsonl").write_text("not in the glob\n")
    assert [r for r in read(spark, path) if r[0][0] == "a"] == [("a_gemini.jsonl", 1, "new")]
    assert len(read(spark, path)) == 3
    assert EF.read_lines(spark, str(tmp_path / "out" / "_attempts")).count() == 0


def test_a_failed_job_leaves_no_half_file(spark, tmp_path):
    path = str(tmp_path / "out")
    EF.write_files(lines(spark, ("a", 1, "old")), path)
    bad = lines(spark, ("a", 1, "new"), ("a", 2, "boom")).withColumn(
        "line", F.when(F.col("line") == "boom", F.raise_error(F.lit("boom"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="boom"):
        EF.write_files(bad, path)
    assert read(spark, path) == [("a_gemini.jsonl", 1, "old")]


def test_bad_lines_are_quarantined_with_their_place(spark, tmp_path):
    (tmp_path / "p_gemini.jsonl").write_text('{"content": "{}", "metadata": {"source_file": "p.pdf"}}\n\nnot json\n')
    rows = sorted(SF.read_extraction_files(spark, str(tmp_path)).collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["_corrupt"]) for r in rows] == [(1, None), (3, "not json")]
    assert rows[0]["metadata"]["source_file"] == "p.pdf"


def test_lines_by_source_are_written_without_a_sort(spark, tmp_path):
    """A task that writes to a folder for each source keeps their files open; its rows are not sorted, hence not spilled."""
    from strata.sinks import files as SK
    from strata.session import apply_conf
    apply_conf(spark)
    rows = [(f"{i} {n}", f"s{i}") for n in range(20) for i in range(20)]
    df = spark.createDataFrame(rows, "line string, source string").coalesce(1)
    SK.write_lines_by(df, str(tmp_path), "line", "source")
    for i in (0, 7, 19):
        got = [r["value"] for r in spark.read.text(f"{tmp_path}/source=s{i}").collect()]
        assert got == [f"{i} {n}" for n in range(20)]
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 20


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Tasks grow with the bytes and by the thousand files, not by the dozen; a large file still ends a partition."""
    for i in range(300):
        (tmp_path / f"{i:03}_gemini.jsonl").write_text(f"line {i}\n\nlast {i}\n")
    few = EF._Reader(str(tmp_path), "*_gemini.jsonl").partitions()
    assert len(few) == 1 and len(few[0].names) == 300
    assert read(spark, str(tmp_path)) == sorted((f"{i:03}_gemini.jsonl", n, f"{w} {i}") for i in range(300) for n, w in ((1, "line"), (3, "last")))
    with open(tmp_path / "1000_gemini.jsonl", "wb") as f:
        f.truncate(EF.PARTITION_BYTES)
    parts = EF._Reader(str(tmp_path), "*_gemini.jsonl").partitions()
    assert len(parts) == 2 and sorted(n for p in parts for n in p.names) == sorted(p.name for p in tmp_path.iterdir())
