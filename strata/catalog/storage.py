"""Store, state and file queries (SRC2-SRC5, SNK1, SNK3, SNK4, JOI3, FLT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..operators import chunk as CH
from ..operators import knn as KNN
from ..operators import store as ST
from ..schemas import MESSAGE, STORE_DOCUMENTS
from ..session import scratch_path
from ..plans import ingest as PI
from ..sinks import files as SK
from ..sources import extraction_files as EF
from ..sources import files as SF
from ..sources import tables as TB
from . import sqlkit as Q
from ._registry import query, round_doubles
from .answers import LAST_N
from .text import _CHUNKS_SQL, MAX_CHUNK, OVERLAP, PAGE_CHUNKS_SQL


def source_files(spark, sf):
    """Documents as the files an ingest finds: '<source>/<doc_id>.pdf' with their text."""
    d = TB.table(spark, sf, "documents")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"), "text")


def chunk_store_rows(files):
    """Files as the chunks an ingest receives."""
    return ST.chunk_rows(CH.sentence_chunks(files, "text", MAX_CHUNK, OVERLAP, keep=("source",)))


_INGEST_SQL = f"""WITH {_CHUNKS_SQL}
    SELECT sha256(concat_ws(chr(31), src, '{K.DEFAULT_SUMMARY_TYPE}', '', chunk_no::VARCHAR, chunk)) AS id,
           chunk AS content, src AS source, '{K.DEFAULT_SUMMARY_TYPE}' AS embedding_type, '' AS prompt
    FROM (SELECT *, source || '/' || doc_id::VARCHAR || '.pdf' AS src FROM chunks)
    WHERE {Q.strip('chunk')} <> ''"""


def _ingested(spark, sf):
    """A fresh store into which every document's chunks were ingested as one batch, again as the same
    batch (a retried run), and as another batch (known sources)."""
    root = scratch_path(spark, "store")
    files = source_files(spark, sf)
    for batch in ("first", "first", "second"):
        # known files are left out by their names, before they are cut into chunks
        ST.ingest(spark, root, chunk_store_rows(ST.unseen(spark, root, files, batch)), batch=batch, check_sources=False)
    return root


@query("ingest_documents", sql=_INGEST_SQL)
def ingest_documents(spark, sf):
    """SNK1: every document's chunks in a fresh store, ingested three times: a batch replaces
    itself, and another batch with the same sources adds nothing."""
    return ST.read_table(spark, f"{_ingested(spark, sf)}/documents", STORE_DOCUMENTS)


@query("ingest_vectors", sql=f"""WITH stored AS ({_INGEST_SQL}),
    v AS {Q.bow('stored', "id || chr(31) || source || chr(31) || embedding_type", 'content')}
    SELECT split_part(id, chr(31), 1) AS id, split_part(id, chr(31), 2) AS source, split_part(id, chr(31), 3) AS embedding_type,
           bucket, cnt AS count FROM v""")
def ingest_vectors(spark, sf):
    """SNK1, the vectors: what the ingest of every document's chunks has stored, as the non-zero
    entries of each vector with its id, source and type."""
    root = scratch_path(spark, "store")
    ST.ingest(spark, root, chunk_store_rows(source_files(spark, sf)), batch="only")
    v = ST.read_vectors(spark, root)
    e = v.select("id", "source", "embedding_type", F.posexplode("embedding").alias("bucket", "w")).where("w > 0")
    return e.select("id", "source", "embedding_type", F.col("bucket").cast("int").alias("bucket"),
                    F.col("w").cast("long").alias("count"))


_STORED = f"""(SELECT sha256(concat_ws(chr(31), source, lang, doc_id::VARCHAR)) AS id, * FROM documents
              WHERE {Q.strip("coalesce(text, '')")} <> '')"""


@query("store_search", sql=f"""WITH {Q.bow_knn(K.SEARCH_TOP_K, d_table=_STORED, d_id='id', d_filter="lang = 'en'")}
    SELECT query_id, rank::INTEGER AS rank, h.id, d.text AS content, d.source, d.lang AS embedding_type,
           round(similarity, 6) AS similarity FROM hits h JOIN {_STORED} d ON d.id = h.id""")
def store_search(spark, sf):
    """FLT3/TOP1 on the stored, typed vector table: whole documents are ingested (``lang`` plays the
    type), then every question searches the vectors of one type, read from their own partitions."""
    root = scratch_path(spark, "typed-store")
    d = TB.table(spark, sf, "documents").select(
        ST.content_id("source", "lang", "doc_id").alias("id"), F.col("text").alias("content"), "source",
        F.col("lang").alias("embedding_type"), F.lit(K.DEFAULT_PROMPT).alias("prompt"))
    ST.ingest(spark, root, d, batch="only")
    hits = KNN.search(ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS), ST.read_vectors(spark, root),
                      TB.benchmark_queries(spark, sf), K.SEARCH_TOP_K, summary_type="en", require_document=False)
    return round_doubles(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "content", "source",
                                     "embedding_type", "similarity"))


@query("store_load", sql="""
    SELECT doc_id AS id, source, lang AS embedding_type, '' AS prompt, length(text)::INTEGER AS content_chars
    FROM documents""")
def store_load(spark, sf):
    """SRC5: the document store read with its fixed schema (content length shown)."""
    d = TB.store_documents(spark, sf)
    return d.select("id", "source", "embedding_type", "prompt", F.length("content").alias("content_chars"))


@query("pending_sources", sql="""
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_sources(spark, sf):
    """JOI3: sources not processed yet (labelled documents count as processed)."""
    d = TB.table(spark, sf, "documents").select("doc_id", "source")
    return ST.pending(d, TB.table(spark, sf, "labels"), "doc_id", retry_failed=False)


@query("progress_upsert", sql=f"""WITH {_CHUNKS_SQL},
    old AS (SELECT d.source, count(*)::BIGINT AS n, 0 AS step FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
            UNION ALL SELECT source, count(*), 1 FROM chunks WHERE lang IS DISTINCT FROM 'en' GROUP BY 1
            UNION ALL SELECT source, count(*), 2 FROM chunks WHERE lang = 'en' GROUP BY 1)
    SELECT source, arg_max(n, step) AS chunks_processed FROM old GROUP BY 1""")
def progress_upsert(spark, sf):
    """SNK3/SRC6: progress per source. The first state counts labelled documents; two updates with
    the chunk counts of all documents, first of the other languages, then of the English ones,
    replace their sources (last write wins)."""
    root = scratch_path(spark, "progress")
    d = TB.table(spark, sf, "documents")
    ST.upsert_progress(spark, root, d.join(TB.table(spark, sf, "labels"), "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks_processed")))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (d.where(~english), d.where(english)):
        c = CH.sentence_chunks(part, "text", MAX_CHUNK, OVERLAP, keep=("source",))
        ST.upsert_progress(spark, root, c.groupBy("source").agg(F.count(F.lit(1)).alias("chunks_processed")))
    return ST.read_progress(spark, root)


@query("ingest_pages", sql=f"""WITH p AS ({PAGE_CHUNKS_SQL})
    SELECT sha256(concat_ws(chr(31), url, '{K.DEFAULT_SUMMARY_TYPE}', '', p.page_id::VARCHAR, text)) AS id, text AS content,
           url AS source, '{K.DEFAULT_SUMMARY_TYPE}' AS embedding_type, '' AS prompt
    FROM p JOIN pages ON pages.page_id = p.page_id""")
def ingest_pages(spark, sf):
    """FLT1/SNK1: the page chunks of every web page in the store, its url the source."""
    root = scratch_path(spark, "page-store")
    p = TB.table(spark, sf, "pages").select(F.col("url").alias("source"), F.col("page_id").alias("page_no"),
                                            TX.html_to_text("html").alias("raw"))
    PI.ingest_pages(spark, p, root, text_col="raw")
    return ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)


@query("ingest_raw_lines", sql=f"""WITH ln AS (
        SELECT doc_id::VARCHAR || '{K.EXTRACTION_SUFFIX}' AS source, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    st AS (SELECT source, line_no, {Q.strip('line')} AS content FROM ln)
    SELECT sha256(concat_ws(chr(31), source, '{K.DEFAULT_SUMMARY_TYPE}', '', line_no::VARCHAR, content)) AS id, content, source,
           '{K.DEFAULT_SUMMARY_TYPE}' AS embedding_type, '' AS prompt FROM st WHERE content <> ''""")
def ingest_raw_lines(spark, sf):
    """SRC2/FLT2/SNK1: every document as a file of its own, whose non-blank lines are stored one by
    one with the file as their source."""
    path, root = scratch_path(spark, "line-files"), scratch_path(spark, "line-store")
    d = TB.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.col("text").alias("line"))
    EF.write_files(d, path)
    PI.ingest_raw_lines(spark, path, root)
    return ST.read_table(spark, f"{root}/documents", STORE_DOCUMENTS)


@query("history_append", sql=f"""
    SELECT conv_id, turn, role, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    WHERE rn <= {LAST_N}""")
def history_append(spark, sf):
    """SNK4: each conversation's earlier turns saved as history, its latest turn appended,
    history trimmed to the last 3 messages per conversation."""
    root = scratch_path(spark, "history")
    c = TB.table(spark, sf, "conversations").select(*[f.name for f in MESSAGE.fields])
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    newest = c.join(last, ["conv_id", "turn"])
    earlier = c.join(last, ["conv_id", "turn"], "left_anti")
    ST.append_history(spark, root, earlier, MESSAGE, LAST_N)
    ST.append_history(spark, root, newest, MESSAGE, LAST_N)
    return ST.read_state(spark, root, MESSAGE)


@query("raw_line_scan", sql=f"""
    SELECT source, {Q.strip('line')} AS content FROM (
        SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE {Q.strip('line')} <> ''""")
def raw_line_scan(spark, sf):
    """SRC2/FLT2: documents written as one text directory per source, read back as
    non-blank stripped lines with their source."""
    path = scratch_path(spark, "raw-text")
    d = TB.table(spark, sf, "documents")
    SK.write_lines_by(d, path, "text", "source")
    return SF.read_raw_lines(spark, path, glob="*.txt", partition_col="source").select("source", "content")


@query("source_file_listing")
def source_file_listing(spark, sf):
    """SRC3: the table files of the input directory with their sizes (metadata only: the
    binary content column is pruned, never read)."""
    return SF.list_files(spark, sf, "*.parquet").select("name", "length")


@query("source_file_validity", sql=f"""
    SELECT doc_id, n_chars AS length,
           n_chars BETWEEN {K.MIN_FILE_BYTES} AND {K.MAX_FILE_BYTES} AS valid,
           CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars > {K.MAX_FILE_BYTES} THEN 'too_large'
                WHEN n_chars < {K.MIN_FILE_BYTES} THEN 'too_small' END AS reason
    FROM documents""")
def source_file_validity(spark, sf):
    """SRC4: the size gate (0.001 MB to 100 MB) with a reason per rejected file; document
    length plays the file size."""
    d = TB.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"))
    valid, reason = SF.size_gate("length")
    return d.select("doc_id", "length", valid, reason)
