"""Extraction queries: envelope scan and write, flattening into tables, metadata rows,
evidence counts (SRC1, SNK2, PRJ2, FLT5, EXT1-EXT7, WIN3, AGG5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..operators import extract as X
from ..session import input_version, scratch_path
from ..sinks import files as SK
from ..sources import adapter as AD
from ..sources import extraction_files as EF
from ..sources import files as SF
from ..sources import tables as TB
from . import sqlkit as Q
from ._registry import query


_ENVELOPE_DIRS: dict = {}


def envelope_dir(spark, sf):
    """The documents' extraction envelopes as JSON-lines files (one directory per source)
    under the shared folder; written once per session and state of the table's files."""
    key = (spark.sparkContext.applicationId, input_version(spark, f"{sf}/documents.parquet"))
    if key not in _ENVELOPE_DIRS:
        path = scratch_path(spark, "extractions")
        SK.write_extraction_jsonl(AD.envelopes(TB.table(spark, sf, "documents")), path)
        _ENVELOPE_DIRS[key] = path
    return _ENVELOPE_DIRS[key]


def paper_rows(spark, sf):
    """Envelope files -> SRC1 scan (per-line quarantine) -> paper structs."""
    raw = SF.read_extractions(spark, envelope_dir(spark, sf), glob="*.txt", partition_col="source")
    return X.with_paper(X.envelope_columns(raw).where("valid"))


def _lst(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# The adapter's rows rebuilt in SQL, without JSON.
PAPERS_SQL = f"""
    s AS (SELECT doc_id, source, lang, n_chars, {Q.sentences('text')} AS sents FROM documents),
    pp AS (SELECT doc_id, source, lang, n_chars, source || '/' || doc_id::VARCHAR || '.pdf' AS source_file,
                  coalesce(sents[1], '') AS title, sents[2:] AS body, (1990 + doc_id % 30)::VARCHAR AS year
           FROM s),
    items AS (SELECT doc_id, source_file, source, lang, unnest(range(0, len(body))) AS i, unnest(body) AS x FROM pp)"""


@query("extract_papers", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, title, year, 'Journal of ' || lang AS journal_name,
           (n_chars % 50 + 1)::VARCHAR AS journal_volume, NULL::VARCHAR AS journal_pages,
           '10.1000/' || doc_id::VARCHAR AS doi FROM pp""")
def extract_papers(spark, sf):
    """EXT1: one row per paper: title, year, journal fields, DOI."""
    return X.papers(paper_rows(spark, sf))


@query("extract_authors", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, 1 AS ordinal, source AS name, lang AS affiliation FROM pp
    UNION ALL SELECT source_file, 2, 'team ' || source, NULL FROM pp""")
def extract_authors(spark, sf):
    """EXT2: authors with their 1-based position (outer: a paper without authors keeps a row)."""
    return X.authors(paper_rows(spark, sf))


@query("extract_keywords", sql=f"""WITH {PAPERS_SQL},
    kw AS (SELECT source_file, unnest(range(0, len(w))) AS i, unnest(w) AS v
           FROM (SELECT source_file, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') AS w FROM pp)),
    kd AS (SELECT source_file, v, min(i) AS i FROM kw GROUP BY 1, 2)
    SELECT source_file, 'keyword' AS kind,
           (row_number() OVER (PARTITION BY source_file ORDER BY i))::INTEGER AS ordinal, v AS value FROM kd
    UNION ALL SELECT source_file, 'objective', 1, title FROM pp""")
def extract_keywords(spark, sf):
    """EXT3/WIN3: keywords and research objectives with ordinals."""
    return X.keywords(paper_rows(spark, sf))


def _ordinal(cond: str) -> str:
    return f"(row_number() OVER (PARTITION BY source_file ORDER BY i))::INTEGER AS ordinal FROM items WHERE {cond}"


@query("extract_methods", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, regexp_extract_all(x, '\\S+')[1] AS name, {_lst(K.METHOD_TYPES)}[i % 4 + 1] AS type,
           x AS description, lang AS tools, {_ordinal('i % 3 = 1')}""")
def extract_methods(spark, sf):
    """EXT4: methods with type, description and tools."""
    return X.methods(paper_rows(spark, sf))


@query("extract_findings", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, x AS statement, {_lst(K.FINDING_TYPES)}[(i // 3) % 3 + 1] AS type,
           'n_words' AS parameter, len(regexp_extract_all(x, '\\S+'))::VARCHAR AS value, 'words' AS units,
           NULL::VARCHAR AS uncertainty, source AS evidence,
           {_lst(K.CONFIDENCE_LEVELS)}[(i // 3) % 3 + 1] AS confidence, {_ordinal('i % 3 = 0')}""")
def extract_findings(spark, sf):
    """EXT5: findings with the measurement struct flattened."""
    return X.findings(paper_rows(spark, sf))


@query("extract_relationships", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, {_lst(K.RELATIONSHIP_TYPES)}[(i // 3) % 3 + 1] AS type, x AS description,
           NULL::VARCHAR AS evidence, {_lst(K.STRENGTHS)}[(i // 3) % 3 + 1] AS strength, {_ordinal('i % 3 = 2')}""")
def extract_relationships(spark, sf):
    """EXT6: relationships."""
    return X.relationships(paper_rows(spark, sf))


@query("extract_locations", sql=f"""WITH {PAPERS_SQL}
    SELECT source_file, source AS name, (doc_id % 180 - 90)::DOUBLE AS lat, (doc_id % 360 - 180)::DOUBLE AS lon,
           {_lst(K.SCALES)}[doc_id % 3 + 1] AS scale, year AS start, NULL::VARCHAR AS "end" FROM pp""")
def extract_locations(spark, sf):
    """EXT7: study location: name, coordinates, scale, time period."""
    return X.locations(paper_rows(spark, sf))


@query("evidence_type_counts", sql=f"""WITH {PAPERS_SQL}
    SELECT CASE i % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'methodology' ELSE 'relationship' END AS embedding_type,
           count(*)::BIGINT AS n FROM items GROUP BY 1""")
def evidence_type_counts(spark, sf):
    """AGG5: evidence rows per extracted kind (findings, methodology, relationships)."""
    ev = X.evidence_rows(paper_rows(spark, sf))
    return ev.groupBy("embedding_type").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_rows", sql=f"""
    SELECT source || '/' || doc_id::VARCHAR || '.pdf' AS source_file, 'processed_at' AS key,
           '{AD.PROCESSED_AT}' AS value FROM documents
    UNION ALL SELECT source || '/' || doc_id::VARCHAR || '.pdf', 'summary_type', '{AD.SUMMARY_TYPE}' FROM documents""")
def metadata_rows(spark, sf):
    """FLT5/FMT6: envelope metadata as key/value rows, without source_file (keys are
    whatever the envelope holds: a map, not a fixed struct)."""
    env = AD.envelopes(TB.table(spark, sf, "documents"))
    m = F.from_json("line", "struct<metadata: map<string, string>>")["metadata"]
    kv = env.select(m["source_file"].alias("source_file"), F.explode(m).alias("key", "value"))
    return kv.where(F.col("key") != "source_file")


@query("extraction_scan", sql=f"""WITH {PAPERS_SQL}
    SELECT source, source_file, '{AD.SUMMARY_TYPE}' AS summary_type, '' AS prompt, title FROM pp""")
def extraction_scan(spark, sf):
    """SRC1/SNK2/PRJ2: envelopes written as one JSON-lines directory per source, then
    scanned back with the fixed schema, a file glob and per-line quarantine; missing
    prompt defaults to ''."""
    return paper_rows(spark, sf).select("source", "source_file", "summary_type", "prompt",
                                        F.col("paper.metadata.title").alias("title"))


@query("extraction_jsonl_roundtrip", sql="""
    SELECT source, count(*)::BIGINT AS n_envelopes, count(DISTINCT doc_id)::BIGINT AS n_files FROM documents GROUP BY 1""")
def extraction_jsonl_roundtrip(spark, sf):
    """SNK2: the per-source JSON-lines output read back: envelopes and distinct source files
    per source directory."""
    path = scratch_path(spark, "extractions-rt")
    SK.write_extraction_jsonl(AD.envelopes(TB.table(spark, sf, "documents")), path)
    raw = SF.read_extractions(spark, path, glob="*.txt", partition_col="source")
    return raw.groupBy("source").agg(F.count(F.lit(1)).alias("n_envelopes"),
                                     F.countDistinct("metadata.source_file").alias("n_files"))


@query("extraction_files", sql=f"""WITH {PAPERS_SQL}
    SELECT doc_id::VARCHAR || '{K.EXTRACTION_SUFFIX}' AS file_name, 1::BIGINT AS line_no, source_file, '{AD.SUMMARY_TYPE}' AS summary_type,
           '' AS prompt, title, NULL::VARCHAR AS quarantined FROM pp
    UNION ALL SELECT doc_id::VARCHAR || '{K.EXTRACTION_SUFFIX}', 2, NULL, NULL, NULL, NULL, '{{"content": ' || doc_id::VARCHAR
    FROM documents WHERE doc_id % 7 = 0""")
def extraction_files(spark, sf):
    """SRC1/SNK2: one file <stem>_gemini.jsonl for each source, read back by its glob with line numbers; a
    line that is not JSON (a second one for every seventh document) is quarantined, the file's
    other line is not."""
    good = AD.envelopes(TB.table(spark, sf, "documents")).select(AD.source_file_col().alias("source_file"), "doc_id", "line")
    cut = good.where("doc_id % 7 = 0").withColumn("line", F.concat(F.lit('{"content": '), F.col("doc_id").cast("string")))
    lines = good.withColumn("n", F.lit(1)).unionByName(cut.withColumn("n", F.lit(2)))
    path = scratch_path(spark, "extraction-files")
    EF.write_files(lines.select(TX.file_stem("source_file").alias("stem"), "line", "n"), path, order_col="n")
    env = X.with_paper(X.envelope_columns(SF.read_extraction_files(spark, path)))
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    return env.select("file_name", "line_no", ok("source_file").alias("source_file"), ok("summary_type").alias("summary_type"),
                      ok("prompt").alias("prompt"), ok("paper.metadata.title").alias("title"), F.col("_corrupt").alias("quarantined"))
