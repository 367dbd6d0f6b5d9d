"""Text queries: chunking, page chunks, cleaners, labels, tokens, JSON checks
(CHK1, FLT1, FLT2, STR1-STR8, JSN1, JSN2, AGG6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonx as J
from ..functions import text as TX
from ..operators import chunk as CH
from ..sources import tables as TB
from . import sqlkit as Q
from ._registry import query

MAX_CHUNK = 200       # chunk size used by the registered chunk queries
OVERLAP = 20          # validated, no effect

_STRIP = Q.strip

_CHUNKS_SQL = f"""
    s AS (SELECT doc_id, source, lang, {Q.sentences("coalesce(text, '')")} AS sents FROM documents),
    p AS (SELECT doc_id, source, lang, flatten(list_transform(sents, lambda x: CASE WHEN length(x) > {MAX_CHUNK}
              THEN list_transform(range(0, length(x), {MAX_CHUNK}), lambda i: {_STRIP(f"substr(x, i + 1, {MAX_CHUNK})")})
              ELSE [x] END)) AS pieces FROM s),
    chunks AS (SELECT doc_id, source, lang, unnest(range(0, len(pieces))) AS chunk_no, unnest(pieces) AS chunk FROM p)"""


@query("sentence_chunks", sql=f"""WITH {_CHUNKS_SQL}
    SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk, length(chunk)::INTEGER AS n_chars FROM chunks""")
def sentence_chunks(spark, sf):
    """CHK1: every document cut into sentence chunks of at most 200 characters."""
    d = TB.table(spark, sf, "documents")
    c = CH.sentence_chunks(d, "text", MAX_CHUNK, OVERLAP, keep=("doc_id",))
    return c.select("doc_id", "chunk_no", "chunk", F.length("chunk").alias("n_chars"))


@query("chunk_stats", sql=f"""WITH {_CHUNKS_SQL}
    SELECT source, count(*)::BIGINT AS n_chunks, sum({Q.word_count('chunk')})::BIGINT AS n_words
    FROM chunks GROUP BY source""")
def chunk_stats(spark, sf):
    """AGG6/STR6: chunks and whitespace words per source (partial aggregation map-side)."""
    d = TB.table(spark, sf, "documents")
    c = CH.sentence_chunks(d, "text", MAX_CHUNK, OVERLAP, keep=("source",))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"),
                                   F.sum(TX.word_count("chunk")).cast("bigint").alias("n_words"))


def _html_sql(x: str) -> str:
    s = (f"regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', "
         f"' ', 'g'), '<[^>]*>', ' ', 'g')")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{ent}', '{ch}')"
    return s


PAGE_CHUNKS_SQL = f"""
    WITH t AS (SELECT page_id, {_STRIP(_html_sql('html'))} AS text FROM pages)
    SELECT page_id, text, n_words::INTEGER AS n_words
    FROM (SELECT *, {Q.word_count('text')} AS n_words FROM t) WHERE n_words > {K.PAGE_MIN_WORDS}"""


@query("page_chunks", sql=PAGE_CHUNKS_SQL)
def page_chunks(spark, sf):
    """FLT1: page text (markup removed), stripped, kept iff it has more than 20 words."""
    p = TB.table(spark, sf, "pages")
    return CH.page_chunks(p.select("page_id", TX.html_to_text("html").alias("raw")), "raw", keep=("page_id",))


def _fence_sql(x: str) -> str:
    s = _STRIP(x)
    o = f"(CASE WHEN starts_with({s}, '```json') THEN substr({s}, 8) ELSE {s} END)"
    return f"(CASE WHEN ends_with({o}, '```') THEN left({o}, length({o}) - 3) ELSE {o} END)"


@query("strip_code_fence", sql=f"""
    WITH v AS (SELECT doc_id, 'both' AS variant, '```json' || chr(10) || text || chr(10) || '```' AS raw FROM documents
               UNION ALL SELECT doc_id, 'open', '```json' || text FROM documents
               UNION ALL SELECT doc_id, 'close', text || '```' FROM documents
               UNION ALL SELECT doc_id, 'none', '  ' || text || '  ' FROM documents)
    SELECT doc_id, variant, {_fence_sql('raw')} AS stripped FROM v""")
def strip_code_fence(spark, sf):
    """STR1: each document wrapped four ways (both fences, opening only, closing only, none)
    and unwrapped again."""
    d = TB.table(spark, sf, "documents")
    t = F.col("text")
    variants = F.array(
        F.struct(F.lit("both").alias("variant"), F.concat(F.lit("```json\n"), t, F.lit("\n```")).alias("raw")),
        F.struct(F.lit("open").alias("variant"), F.concat(F.lit("```json"), t).alias("raw")),
        F.struct(F.lit("close").alias("variant"), F.concat(t, F.lit("```")).alias("raw")),
        F.struct(F.lit("none").alias("variant"), F.concat(F.lit("  "), t, F.lit("  ")).alias("raw")))
    v = d.select("doc_id", F.inline(variants))
    return v.select("doc_id", "variant", TX.strip_code_fence("raw").alias("stripped"))


def file_name_col():
    """Test-data file name of a document: its first sentence, a year, '.pdf'."""
    title = TX.first_sentence("text")
    year = (F.lit(1990) + F.pmod(F.col("doc_id"), F.lit(30))).cast("string")
    return F.concat(title, F.lit(" "), year, F.lit(".pdf"))


FILE_NAME_SQL = f"coalesce(({Q.sentences('text')})[1], '') || ' ' || (1990 + doc_id % 30)::VARCHAR || '.pdf'"

_W = "[\\p{L}\\p{N}_]"
_NW = "[^\\p{L}\\p{N}_]"


def clean_filename_sql(x: str) -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '\\(pdf\\)', '', 'gi')"
    s = f"regexp_replace({s}, '\\.pdf$', '', 'i')"
    year = f"'(^|{_NW})\\p{{Nd}}{{4}}($|{_NW})'"
    s = f"regexp_replace(regexp_replace({s}, {year}, '\\1\\2', 'g'), {year}, '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '^(the|a|an)\\s+', '')"
    s = f"regexp_replace({s}, '\\([^)]*\\)', '', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    s = _STRIP(f"regexp_replace({s}, '\\s+', ' ', 'g')")
    stop = ", ".join(f"'{w}'" for w in K.NAME_STOP_WORDS)
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda w: w NOT IN ({stop})), ' ')"


@query("clean_filename", sql=f"""
    WITH n AS (SELECT doc_id, {FILE_NAME_SQL} AS file_name FROM documents)
    SELECT doc_id, file_name, {clean_filename_sql('file_name')} AS clean_name FROM n""")
def clean_filename(spark, sf):
    """STR2: file-name normalisation (case, '(pdf)', extension, years, articles, brackets,
    punctuation, spaces, stop words) over every document's file name."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    n = d.select("doc_id", file_name_col().alias("file_name"))
    return n.select("doc_id", "file_name", TX.clean_filename("file_name").alias("clean_name"))


def clean_content_sql(x: str) -> str:
    s = f"regexp_replace({x}, 'Fig\\.\\s*\\p{{Nd}}+.*?\\n', '', 'g')"
    s = f"regexp_replace({s}, 'Table\\s*\\p{{Nd}}+.*?\\n', '', 'g')"
    s = f"regexp_replace({s}, '\\({_W}+\\s+\\p{{Nd}}{{1,2}}\\s+{_W}+\\s+\\p{{Nd}}{{4}}\\)', '', 'g')"
    s = f"regexp_replace({s}, '\\p{{Nd}}+\\s*$', '', 'g')"
    s = f"regexp_replace({s}, '(?m)^\\s*\\p{{Nd}}+\\s*$', '', 'g')"
    return _STRIP(f"regexp_replace({s}, '\\s+', ' ', 'g')")


@query("clean_content", sql=f"SELECT doc_id, {clean_content_sql('text')} AS cleaned FROM documents")
def clean_content(spark, sf):
    """STR3: the six cleaning rules over every whole document text."""
    d = TB.table(spark, sf, "documents")
    return d.select("doc_id", TX.clean_content("text").alias("cleaned"))


@query("source_label", sql="""
    WITH b AS (SELECT page_id, string_split(url, '/')[-1] AS base FROM pages)
    SELECT page_id, replace(base, '_gemini.jsonl', '') AS label,
           regexp_replace(base, '(.)\\.[^.]*$', '\\1') || '_gemini.jsonl' AS output_name FROM b""")
def source_label(spark, sf):
    """STR4/STR5: display label (base name minus the extraction suffix) and extraction
    output name (stem + suffix) of every page URL."""
    p = TB.table(spark, sf, "pages")
    return p.select("page_id", TX.source_label("url").alias("label"),
                    TX.extraction_output_name("url").alias("output_name"))


@query("response_tokens", sql="""
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations
               WHERE role = 'assistant'),
    t AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS pos, unnest(ws) AS tok FROM w)
    SELECT conv_id, turn, pos::INTEGER AS pos, tok || ' ' AS token FROM t""")
def response_tokens(spark, sf):
    """STR7: every assistant response as whitespace tokens, each with a trailing space."""
    c = TB.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    t = c.select("conv_id", "turn", F.posexplode(TX.words("text")).alias("pos", "tok"))
    return t.select("conv_id", "turn", "pos", F.concat("tok", F.lit(" ")).alias("token"))


@query("json_validity", sql="""
    SELECT event_id, coalesce(json_valid(props), false) AS valid_full,
           coalesce(json_valid(left(props, length(props) - 1)), false) AS valid_truncated
    FROM events""")
def json_validity(spark, sf):
    """JSN1: JSON validity of every event payload, and of the payload cut by one character."""
    e = TB.table(spark, sf, "events")
    cut = F.left(F.col("props"), F.length("props") - F.lit(1))
    return e.select("event_id", J.is_valid_json("props").alias("valid_full"),
                    J.is_valid_json(cut).alias("valid_truncated"))


@query("json_inject_source", sql="""
    SELECT event_id, 'user' || user_id AS source,
           json_merge_patch(props, json_object('source', 'user' || user_id))::VARCHAR AS evidence
    FROM events""")
def json_inject_source(spark, sf):
    """JSN2: the source label written into every JSON object (replacing any existing one);
    numbers stay numbers; non-objects give NULL."""
    e = TB.table(spark, sf, "events")
    src = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select("event_id", src.alias("source"), J.inject_field("props", "source", src).alias("evidence"))


_VARIANTS = {"object": "{0}", "array": "[{0}]", "spaces": " {0} ", "trailing": "{0} x", "second": "{0},{0}", "open": "{{{0}",
             "text": '"{0}', "number": "7", "empty": "", "bracket": "{0}]", "two lists": "1],[{0}"}


def _variant_sql(form: str) -> str:
    return "'" + form.replace("{{", "\0").replace("{0}", "' || props || '").replace("\0", "{") + "'"


@query("json_variants", sql="""
    WITH v AS (""" + " UNION ALL ".join(f"SELECT event_id, user_id, '{n}' AS variant, {_variant_sql(f)} AS t FROM events"
                                        for n, f in _VARIANTS.items()) + """)
    SELECT event_id, variant, coalesce(json_valid(t), false) AS valid,
           CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN json_merge_patch(t, json_object('source', 'user' || user_id))::VARCHAR
           END AS evidence FROM v""")
def json_variants(spark, sf):
    """JSN1/JSN2 on texts that are not one JSON object: lists, texts and numbers are valid but hold no
    source; trailing text, a second value, open or empty texts are not valid."""
    e = TB.table(spark, sf, "events")

    def text(form):
        parts = form.replace("{{", "\0").split("{0}")
        cols = [F.lit(parts[0].replace("\0", "{"))]
        for p in parts[1:]:
            cols += [F.col("props"), F.lit(p.replace("\0", "{"))]
        return F.concat(*cols)
    v = e.select("event_id", "user_id", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), text(f).alias("t"))
                                                           for n, f in _VARIANTS.items()])))
    return v.select("event_id", "variant", J.is_valid_json("t").alias("valid"),
                    J.inject_field("t", "source", F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("evidence"))
