"""Driver contract: entry() runs; every oracle belongs to a registered query; the streaming
history equals the batch window and survives restarts; reports print a hand-made record."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.operators import report as R
from tests.conftest import SF001


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"query_id", "rank", "id", "similarity"}
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 60


def test_stream_history_equals_window(spark):
    qs = E.queries()
    a = {tuple(r) for r in qs["stream_history"](spark, SF001).collect()}
    b = {tuple(r) for r in qs["last_n_turns"](spark, SF001).collect()}
    assert a == b and a


RECORD = {
    "metadata": {"title": "Braided channels of a gravel plain", "authors": [
        {"name": "Q. Lim", "affiliation": "Field station"}, {"name": "R. Osei", "affiliation": None}],
        "year": 2031, "journal": {"name": "Notes on gravel", "volume": None, "pages": "7-19"},
        "doi": None, "keywords": ["gravel", "braids", "floods"]},
    "study": {"location": {"name": "Plain", "coordinates": {"lat": -0.0001, "lon": 12500000.5}, "scale": "local",
                           "time_period": {"start": 0, "end": 1e20}},
              "objectives": ["Count channels"],
              "methods": [{"name": "Survey", "type": "field", "description": "Lines", "tools": ["tape", "level"]}]},
    "findings": [{"statement": "Channels moved", "type": "measurement",
                  "data": {"parameter": "shift", "value": 0.00001, "units": "km", "uncertainty": 2.50},
                  "evidence": "maps", "confidence": "low"}],
}


def test_report_on_a_record(spark):
    df = spark.createDataFrame([(json.dumps(RECORD),), ("no record",), (json.dumps(RECORD) + " trailing",)],
                               "content string")
    rows = [r["r"] for r in R.with_record(df).select(R.report_markdown(F.col("_v")).alias("r")).collect()]
    good, *bad = rows
    for part in ("**Title**: Braided channels of a gravel plain", "  Affiliation: None",
                 "Coordinates: -0.0001°, 12500000.5°", "Time Period: 0 to 1e+20", "1. Count channels",
                 "Tools: tape, level", "      Value: 1e-05\n      Units: km\n      Uncertainty: 2.5",
                 "**Keywords**: gravel, braids, floods", "## Research Findings"):
        assert part in good, (part, good)
    assert "## Identified Relationships" not in good          # key absent: section absent
    assert all(x.startswith("Error formatting entry") for x in bad)
    a = df.limit(1).select(R.format_authors(F.try_parse_json("content")).alias("a")).first()["a"]
    assert a == "Q. Lim (Field station), R. Osei"


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from strata.schemas import MESSAGE
    from strata.streaming import jobs as SJ
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    say = lambda turns: spark.createDataFrame([(1, t, "user", f"m{t}") for t in turns],
                                              "conv_id long, turn long, role string, text string").select(
        *[f.name for f in MESSAGE.fields]).coalesce(1).write.mode("append").parquet(land)
    for turns, want in (((0, 1, 2), [1, 2]), ((3,), [2, 3]), ((), [2, 3])):
        if turns:
            say(turns)
        SJ.stream_history(spark, land, out, 2)
        assert sorted(r["turn"] for r in SJ.latest_history(spark, out).collect()) == want


def test_stream_ingest_equals_batch_ingest(spark):
    qs = E.queries()
    a = {tuple(r) for r in qs["stream_ingest"](spark, SF001).collect()}
    b = {tuple(r) for r in qs["ingest_documents"](spark, SF001).collect()}
    assert a == b and a


def test_queries_leave_the_settings_alone(spark):
    from strata.session import apply_conf
    apply_conf(spark)
    before = dict(spark.conf.getAll)
    qs = E.queries()
    for name in ("vector_search", "report_entries", "fuzzy_name_pairs", "store_search", "op6_token_counts", "op8_simhash",
                 "op11_hard_negatives"):
        if name in qs:
            qs[name](spark, SF001).count()
            assert dict(spark.conf.getAll) == before, name
