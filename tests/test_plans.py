"""End-to-end plans on small hand-made inputs."""

import json
import tempfile

from pyspark.sql import functions as F

from strata import constants as K
from strata.operators import store as ST
from strata.operators import report as R
from strata.plans import cleaning, ingest, reports, retrieval
from strata.schemas import STORE_DOCUMENTS, STORE_VECTORS


def test_ingest_then_answer(spark):
    d = tempfile.mkdtemp(prefix="strata-plan-")
    rec = {"findings": [{"statement": "Rivers transport sediment to the delta", "type": "observation"}],
           "study": {"methods": [{"name": "coring", "type": "field", "description": "Sediment cores were taken"}]},
           "relationships": [{"type": "causal", "description": "Floods raise sediment transport"}]}
    lines = [json.dumps({"content": json.dumps(rec), "metadata": {"source_file": "p1.pdf"}}), "not json"]
    with open(f"{d}/p1_gemini.jsonl", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    with open(f"{d}/ignored.txt", "w") as fh:
        fh.write(lines[0] + "\n")
    root = f"{d}/store"
    bad = ingest.ingest_extractions(spark, d, root)
    assert bad.count() == 1
    docs = ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)
    vecs = ST.read_table(spark, f"{root}/embeddings", STORE_VECTORS)
    assert sorted(r["embedding_type"] for r in docs.collect()) == ["finding", "methodology", "relationship"]
    q = spark.createDataFrame([(1, "sediment transport rivers"), (2, "zzz qqq")], "query_id long, query string")
    out = retrieval.answer_questions(q, docs, vecs, min_similarity=0.3)
    ans = {r["query_id"]: r["answer"] for r in out.answers.collect()}
    assert ans[2] == K.NO_ANSWER_TEXT and ans[1].endswith(" <STOP>")
    ctx = out.contexts.collect()
    assert len(ctx) == 1 and "FINDINGS:" in ctx[0]["context"] and '"source":"p1.pdf"' in ctx[0]["context"]


def test_report_pages(spark):
    import os
    d = tempfile.mkdtemp(prefix="strata-rep-")
    os.makedirs(f"{d}/in/source=a")
    rec = {"metadata": {"title": "T <1>", "authors": []}}
    with open(f"{d}/in/source=a/p_gemini.jsonl", "w") as fh:
        fh.write(json.dumps({"content": json.dumps(rec), "metadata": {"source_file": "p.pdf"}}) + "\n{broken\n")
    entries = reports.write_reports(spark, f"{d}/in", f"{d}/out", partition_col="source")
    html = [r["html"] for r in entries.collect()]
    assert len(html) == 2 and any("Error decoding" in h for h in html) and any("T &lt;1&gt;" in h for h in html)
    page = spark.read.text(f"{d}/out").collect()
    assert page and any("<html>" in r["value"] for r in page)


def test_cleaning_plan(spark):
    files = spark.createDataFrame([(1, "same", "River Delta 2020.pdf"), (2, "same", "other.pdf"),
                                   (3, "x", "river delta.pdf"), (4, "y", "unique name.pdf")],
                                  "id long, content string, name string")
    c = cleaning.clean(files, id_col="id", content_col="content", name_col="name")
    assert {r["id"]: r["leader_id"] for r in c.similar.collect()} == {3: 1}
    s = c.summary.first()
    assert (s["removed"], s["skipped"]) == (2, 0)
    assert sorted(r["id"] for r in c.survivors.collect()) == [1, 4]


def test_pages_are_whole_files_of_bounded_size(spark, tmp_path):
    """1,200 equal entries without key or group, and a few of another group: every page is one
    file of one page, no page is much larger than asked for, and nothing is lost."""
    rows = [(None, None, "<pre>bad line</pre>\n")] * 1200 + [("s", f"f{i}", f"<pre>{i}</pre>\n") for i in range(5)]
    df = spark.createDataFrame(rows, "source string, source_file string, html string").repartition(3)
    back = R.write_html_pages(df, str(tmp_path / "pages"), per_page=100)
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(key, back.collect())) == sorted(map(key, rows))
    files = spark.read.text(str(tmp_path / "pages"), wholetext=True).collect()
    assert len(files) == 13 and all(f["value"].count("<html>") == 1 for f in files)
    assert max(f["value"].count("<pre>") for f in files) < 200
    found = R.read_html_pages(spark, str(tmp_path / "pages")).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {None: 1200, "s": 5}


def test_pages_and_raw_lines_reach_the_store(spark, tmp_path):
    root = str(tmp_path / "store")
    long = " ".join(f"w{i}" for i in range(21))
    pages = spark.createDataFrame([("a.html", 1, f"  {long}\n"), ("a.html", 2, long[:-4]), ("b.html", 1, None), ("b.html", 2, long)],
                                  "source string, page_no int, text string")
    ingest.ingest_pages(spark, pages, root, batch="pages")
    (tmp_path / "p_gemini.jsonl").write_text("{line}\n\n  twice \ntwice\n")
    ingest.ingest_raw_lines(spark, str(tmp_path), root, batch="lines")
    rows = ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS).collect()
    assert sorted((r["source"], r["content"]) for r in rows) == [
        ("a.html", long), ("b.html", long), ("p_gemini.jsonl", "twice"), ("p_gemini.jsonl", "twice"), ("p_gemini.jsonl", "{line}")]
    assert len({r["id"] for r in rows}) == 5 and ST.read_vectors(spark, root).count() == 5


def test_questions_and_answers_follow_the_conversation(spark, tmp_path):
    from strata.plans import chat
    from strata.schemas import TIMED_MESSAGE
    root = str(tmp_path / "log")
    old = spark.createDataFrame([(1, 0, "user", "hello", "5.0"), (1, 1, "assistant", "hi", "6.0")], TIMED_MESSAGE)
    ST.append_history(spark, root, old, TIMED_MESSAGE, 5)
    q = spark.createDataFrame([(1, 8, "why?"), (1, 7, "what?"), (2, 9, "how?")], "conv_id long, query_id long, query string")
    a = spark.createDataFrame([(7, "that"), (8, "so"), (9, None)], "query_id long, answer string")
    chat.log_answers(spark, root, q, a, F.lit(9.5), 5)
    got = sorted(tuple(r) for r in ST.read_state(spark, root, TIMED_MESSAGE).collect())
    assert got == [(1, 1, "assistant", "hi", "6.0"), (1, 2, "user", "what?", "9.5"), (1, 3, "assistant", "that", "9.5"),
                   (1, 4, "user", "why?", "9.5"), (1, 5, "assistant", "so", "9.5"), (2, 0, "user", "how?", "9.5"),
                   (2, 1, "assistant", None, "9.5")]
