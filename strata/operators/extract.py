"""Extraction records to tables (SRC1 parsing, STR1/JSN1 validity split, EXT1-EXT7, AGG5).

Each envelope line is parsed inside its own row (``from_json`` with the fixed schema), and
nested arrays become rows with ``posexplode``: a narrow, shuffle-free plan whatever the
number of papers. Ordinals are 1-based, as the report numbers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonx as J
from ..functions import text as TX
from ..schemas import PAPER


def envelope_columns(raw: DataFrame) -> DataFrame:
    """Envelope rows as the JSON-lines reader gives them (``content``, ``metadata`` struct, ``_corrupt``) ->
    (content, source_file, processed_at, summary_type, prompt, valid).

    A missing ``prompt`` becomes '' and a missing ``summary_type`` 'finding' (the ingest defaults);
    ``valid`` is false for a line that is not JSON or whose content is not JSON, which the caller
    routes to quarantine instead of failing the job."""
    content = TX.strip_code_fence(F.col("content"))
    cols = [c for c in raw.columns if c not in ("content", "metadata", "_corrupt")]
    out = raw.select(
        *cols,
        TX.once(content).alias("content"),
        F.col("metadata.source_file").alias("source_file"),
        F.col("metadata.processed_at").alias("processed_at"),
        F.coalesce(F.col("metadata.summary_type"), F.lit(K.DEFAULT_SUMMARY_TYPE)).alias("summary_type"),
        F.coalesce(F.col("metadata.prompt"), F.lit(K.DEFAULT_PROMPT)).alias("prompt"),
        F.col("_corrupt"),
        F.col("_corrupt").isNull().alias("_line_ok"))
    return out.withColumn("valid", TX.once(F.col("_line_ok") & J.is_valid_json("content"))).drop("_line_ok")


def with_paper(df: DataFrame, content_col: str = "content") -> DataFrame:
    return df.withColumn("paper", F.from_json(F.col(content_col), PAPER))


def papers(p: DataFrame) -> DataFrame:
    m = F.col("paper.metadata")
    return p.select("source_file", m["title"].alias("title"), m["year"].alias("year"),
                    m["journal"]["name"].alias("journal_name"), m["journal"]["volume"].alias("journal_volume"),
                    m["journal"]["pages"].alias("journal_pages"), m["doi"].alias("doi"))


def _explode(p: DataFrame, arr: str, outer: bool = False) -> DataFrame:
    fn = F.posexplode_outer if outer else F.posexplode
    return (p.select("source_file", TX.once(arr).alias("_items")).select("source_file", fn("_items").alias("_pos", "e"))
             .withColumn("ordinal", (F.col("_pos") + 1).cast("int")).drop("_pos"))


def authors(p: DataFrame) -> DataFrame:
    x = _explode(p, "paper.metadata.authors", outer=True)
    return x.select("source_file", "ordinal", F.col("e.name").alias("name"), F.col("e.affiliation").alias("affiliation"))


def keywords(p: DataFrame) -> DataFrame:
    """Keywords and objectives of a paper in one array: the record is read and parsed once."""
    def items(arr: str, kind: str):
        return F.transform(F.coalesce(F.col(arr), F.array().cast("array<string>")), lambda e, i: F.struct(
            F.lit(kind).alias("kind"), (i + 1).cast("int").alias("ordinal"), e.alias("value")))
    return p.select("source_file", F.inline(F.concat(items("paper.metadata.keywords", "keyword"),
                                                     items("paper.study.objectives", "objective"))))


def methods(p: DataFrame) -> DataFrame:
    x = _explode(p, "paper.study.methods")
    return x.select("source_file", "ordinal", F.col("e.name").alias("name"), F.col("e.type").alias("type"),
                    F.col("e.description").alias("description"),
                    F.array_join(F.col("e.tools"), ", ").alias("tools"))


def findings(p: DataFrame) -> DataFrame:
    x = _explode(p, "paper.findings")
    return x.select("source_file", "ordinal", F.col("e.statement").alias("statement"), F.col("e.type").alias("type"),
                    F.col("e.data.parameter").alias("parameter"), F.col("e.data.value").alias("value"),
                    F.col("e.data.units").alias("units"), F.col("e.data.uncertainty").alias("uncertainty"),
                    F.col("e.evidence").alias("evidence"), F.col("e.confidence").alias("confidence"))


def relationships(p: DataFrame) -> DataFrame:
    x = _explode(p, "paper.relationships")
    return x.select("source_file", "ordinal", F.col("e.type").alias("type"),
                    F.col("e.description").alias("description"), F.col("e.evidence").alias("evidence"),
                    F.col("e.strength").alias("strength"))


def locations(p: DataFrame) -> DataFrame:
    loc = F.col("paper.study.location")
    return p.select("source_file", loc["name"].alias("name"), loc["coordinates"]["lat"].alias("lat"),
                    loc["coordinates"]["lon"].alias("lon"), loc["scale"].alias("scale"),
                    loc["time_period"]["start"].alias("start"), loc["time_period"]["end"].alias("end"))


def evidence_rows(p: DataFrame) -> DataFrame:
    """Findings, methods and relationships as store rows: (source_file, embedding_type,
    ordinal, content = the item as JSON, text = its sentence). These are the three types
    the context assembly groups by. One parse and one explode per paper: the three arrays
    are turned into one array of a common struct first."""
    def items(arr: str, kind: str, text_field: str):
        return F.transform(F.coalesce(F.col(arr), F.array()), lambda e, i: F.struct(
            F.lit(kind).alias("embedding_type"), (i + 1).cast("int").alias("ordinal"),
            F.to_json(e).alias("content"), e[text_field].alias("text")))
    allv = F.concat(items("paper.findings", "finding", "statement"),
                    items("paper.study.methods", "methodology", "description"),
                    items("paper.relationships", "relationship", "description"))
    return p.select("source_file", F.inline(allv))
