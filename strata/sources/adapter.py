"""Test-data adapter: one extraction envelope per ``documents`` row.

No given table holds extraction JSON, so each document is turned into the record an
extractor would return, by fixed rules:

* title = first sentence; objectives = [title]; keywords = distinct title words (lower case)
* authors = [{name: source, affiliation: lang}, {name: "team " + source, affiliation: null}]
* year = 1990 + doc_id mod 30; journal = {"Journal of " + lang, volume = n_chars mod 50 + 1, pages: null}
* doi = "10.1000/" + doc_id; location = {source, (doc_id mod 180 - 90, doc_id mod 360 - 180),
  scale by doc_id mod 3, time_period = {year, null}}
* the sentences after the title, numbered i = 0, 1, ...: i mod 3 = 0 are findings, 1 methods,
  2 relationships; their enum fields cycle with i (method type by i mod 4, the others by
  (i div 3) mod 3).

The envelope is ``{"content": <record as JSON text>, "metadata": {"source_file":
"<source>/<doc_id>.pdf", "processed_at": PROCESSED_AT, "summary_type": "comprehensive"}}``.
The DuckDB oracles rebuild the same rows from ``documents`` without the JSON round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX

PROCESSED_AT = "2024-01-01T00:00:00"
SUMMARY_TYPE = "comprehensive"


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def source_file_col() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))


def paper_struct() -> Column:
    """The record of one document; expects the ``_s`` (sentences) and ``_title`` columns
    added by ``envelopes`` so the text is split once per row."""
    s = F.col("_s")
    title = F.col("_title")
    body = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
    year = (F.lit(1990) + F.pmod("doc_id", F.lit(30))).cast("string")
    items = F.transform(body, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def of_kind(r):
        return F.filter(items, lambda e: F.pmod(e["i"], F.lit(3)) == r)

    cyc = lambda e: F.pmod(F.floor(e["i"] / 3).cast("int"), F.lit(3))
    methods = F.transform(of_kind(1), lambda e: F.struct(
        F.try_element_at(TX.words(e["x"]), F.lit(1)).alias("name"),
        _pick(K.METHOD_TYPES, F.pmod(e["i"], F.lit(4))).alias("type"),
        e["x"].alias("description"),
        F.array(F.col("lang")).alias("tools")))
    findings = F.transform(of_kind(0), lambda e: F.struct(
        e["x"].alias("statement"),
        _pick(K.FINDING_TYPES, cyc(e)).alias("type"),
        F.struct(F.lit("n_words").alias("parameter"), TX.word_count(e["x"]).cast("string").alias("value"),
                 F.lit("words").alias("units"), F.lit(None).cast("string").alias("uncertainty")).alias("data"),
        F.col("source").alias("evidence"),
        _pick(K.CONFIDENCE_LEVELS, cyc(e)).alias("confidence")))
    relationships = F.transform(of_kind(2), lambda e: F.struct(
        _pick(K.RELATIONSHIP_TYPES, cyc(e)).alias("type"),
        e["x"].alias("description"),
        F.lit(None).cast("string").alias("evidence"),
        _pick(K.STRENGTHS, cyc(e)).alias("strength")))
    return F.struct(
        F.struct(title.alias("title"),
                 F.array(F.struct(F.col("source").alias("name"), F.col("lang").alias("affiliation")),
                         F.struct(F.concat(F.lit("team "), F.col("source")).alias("name"),
                                  F.lit(None).cast("string").alias("affiliation"))).alias("authors"),
                 year.alias("year"),
                 F.struct(F.concat(F.lit("Journal of "), F.col("lang")).alias("name"),
                          (F.pmod("n_chars", F.lit(50)) + 1).cast("string").alias("volume"),
                          F.lit(None).cast("string").alias("pages")).alias("journal"),
                 F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string")).alias("doi"),
                 F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("keywords")
                 ).alias("metadata"),
        F.struct(
            F.struct(F.col("source").alias("name"),
                     F.struct((F.pmod("doc_id", F.lit(180)) - 90).cast("double").alias("lat"),
                              (F.pmod("doc_id", F.lit(360)) - 180).cast("double").alias("lon")).alias("coordinates"),
                     _pick(K.SCALES, F.pmod("doc_id", F.lit(3))).alias("scale"),
                     F.struct(year.alias("start"), F.lit(None).cast("string").alias("end")).alias("time_period")
                     ).alias("location"),
            F.array(title).alias("objectives"),
            methods.alias("methods")).alias("study"),
        findings.alias("findings"),
        relationships.alias("relationships"))


def envelopes(documents: DataFrame) -> DataFrame:
    """(source, doc_id, line): one JSON envelope line per document."""
    meta = F.struct(source_file_col().alias("source_file"), F.lit(PROCESSED_AT).alias("processed_at"),
                    F.lit(SUMMARY_TYPE).alias("summary_type"))
    # explicit nulls in the record (an extractor writes null for unknown values)
    content = F.to_json(paper_struct(), {"ignoreNullFields": "false"})
    env = F.to_json(F.struct(content.alias("content"), meta.alias("metadata")))
    d = documents.select("source", "doc_id", "lang", "n_chars", TX.sentences("text").alias("_s"))
    d = d.withColumn("_title", F.coalesce(F.try_element_at("_s", F.lit(1)), F.lit("")))
    return d.select("source", "doc_id", env.alias("line"))
