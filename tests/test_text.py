"""Text and JSON functions against hand-written expectations."""

import json

from pyspark.sql import functions as F

from strata.functions import jsonx as J
from strata.functions import text as TX


def one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select("i", col_fn(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def test_strip_matches_python(spark):
    vals = ["  x \u0085", "\x1c\ty\r", "   ", "", None, "　z ", "in ner"]
    assert one(spark, TX.ustrip, vals) == [None if v is None else v.strip() for v in vals]
    assert one(spark, TX.word_count, vals) == [None if v is None else len(v.split()) for v in vals]


def test_clean_filename_cases(spark):
    names = ["The River (2020).pdf", "(pdf) a delta.PDF", "2020.pdf", "An analysis of the 1999 2000 floods.pdf",
             "Sediment_Transport-in rivers.pdf", "and or the.pdf", "ü-ber Straße (draft) 1234x.pdf", "a" * 300 + ".pdf"]
    assert one(spark, TX.clean_filename, names) == [
        "river", "a delta", "", "analysis floods", "sediment_transport rivers", "", "ü ber straße 1234x", "a" * 300]


def test_clean_content_cases(spark):
    texts = ["Fig. 3 shows x\nkept line here", "Table 2: values\nrest", "as seen (Smith 12 March 2020) here",
             "ends with page 12", "12\nbody text\n  7  \nmore", "  spaced   out  ", "Fig.12 no newline"]
    assert one(spark, TX.clean_content, texts) == [
        "kept line here", "rest", "as seen here", "ends with page", "body text more", "spaced out", "Fig.12 no newline"]


def test_code_fence(spark):
    vals = ["```json\n{\"a\": 1}\n```", "```json{\"a\": 1}", "{\"a\": 1}```", "```", "```json", "  plain  "]

    assert one(spark, TX.strip_code_fence, vals) == ['\n{"a": 1}\n', '{"a": 1}', '{"a": 1}', "", "", "plain"]


def test_labels_and_question(spark):
    paths = ["/a/b/paper_gemini.jsonl", "x_gemini.jsonl.bak", "dir/", "plain"]
    assert one(spark, TX.source_label, paths) == ["paper", "x.bak", "", "plain"]
    assert one(spark, TX.extraction_output_name, ["/d/My Paper.pdf", "a.b.c", "noext"]) == \
        ["My Paper_gemini.jsonl", "a.b_gemini.jsonl", "noext_gemini.jsonl"]
    assert one(spark, TX.is_question, ["What is x", "how so", "Why", "whatever", "tell me"]) == \
        [True, True, True, True, False]


def test_json_validity_like_python(spark):
    vals = ['{"a": 1}', "[1]", '"x"', "{bad", "", None, '{"a":1,"a":2}', "null", '{"a":1} junk', "1, 2", "[1] [2]",
            '{"a":1}{"b":2}', '{"a":1', "[1] , [2]", "1}", "1]", " 7 ", '{"a":1}]', '"a" "b"', "]", "1],[2"]

    def py(v):
        try:
            json.loads(v)
            return True
        except (TypeError, ValueError):
            return False
    assert one(spark, J.is_valid_json, vals) == [py(v) for v in vals]


def test_inject_source(spark):
    df = spark.createDataFrame([(0, '{"k": 69}'), (1, '{"source": "old", "v": 1.5, "n": null}'), (2, "[1]"),
                                (3, '"x"'), (4, "{bad"), (5, '{"a":1} junk')], "i int, j string")
    rows = {r["i"]: r["o"] for r in df.select("i", J.inject_field("j", "source", F.lit("s.pdf")).alias("o")).collect()}
    assert json.loads(rows[0]) == {"k": 69, "source": "s.pdf"}
    assert json.loads(rows[1]) == {"source": "s.pdf", "v": 1.5, "n": None}
    assert rows[2] is None and rows[3] is None and rows[4] is None and rows[5] is None


def test_envelopes_are_parsed_once(spark):
    """A filter on validity does not copy the parse of the line or of its content into itself."""
    from strata.operators import extract as X
    from strata.sources import files as SF
    good = json.dumps({"content": json.dumps({"metadata": {"keywords": ["b", "a"]}, "study": {"objectives": ["o"]}}),
                       "metadata": {"source_file": "f"}})
    bad = ['{"content": ', json.dumps({"content": "{", "metadata": {"source_file": "g"}}), "3", json.dumps({"content": "{}"})]
    lines = spark.createDataFrame([(x,) for x in [good, *bad]], "value string")
    env = X.envelope_columns(SF.parse_envelope_lines(lines, "value", []))
    k = X.keywords(X.with_paper(env.where("valid")))
    assert k._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2
    assert sorted(tuple(r) for r in k.collect()) == [("f", "keyword", 1, "b"), ("f", "keyword", 2, "a"), ("f", "objective", 1, "o")]
    assert [r["valid"] for r in env.collect()].count(True) == 2
    assert [r[0] for r in env.where("_corrupt is not null").select("_corrupt").collect()] == ['{"content": ']
    only = spark.createDataFrame([("f", None, ["o"]), ("g", ["k"], None)], "source_file string, k array<string>, o array<string>")
    p = only.selectExpr("source_file", "struct(struct(k as keywords) as metadata, struct(o as objectives) as study) as paper")
    assert sorted(tuple(r) for r in X.keywords(p).collect()) == [("f", "objective", 1, "o"), ("g", "keyword", 1, "k")]


def test_spaces_are_those_that_python_strips():
    assert set(TX.SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}
