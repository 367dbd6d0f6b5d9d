"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one
JSON line {"metric", "value", "unit", "queries", "sf", ...} on stdout.

Each query is fully executed with the ``noop`` sink (no driver collect), timed separately;
``value`` is the sum. ``BENCH_QUERIES=all`` (or a comma list) overrides the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "vector_search", "vector_search_filtered", "similarity_threshold", "vector_search_batch", "encode_text",
    "sentence_chunks", "chunk_stats", "page_chunks", "clean_content", "clean_filename", "json_inject_source",
    "extract_findings", "evidence_type_counts", "context_blocks", "cited_answers", "last_n_turns",
    "exact_duplicate_groups", "fuzzy_duplicate_groups", "ingest_documents", "report_markdown", "stream_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from strata.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="strata-bench", shuffle_partitions=2 * cpus,
                      extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g", "strata.scan.partitions": str(cpus)})
    spark.sparkContext.setLogLevel("ERROR")
    from strata import catalog
    qs = catalog.queries()
    sel = os.environ.get("BENCH_QUERIES", "")
    names = list(qs) if sel == "all" else ([s for s in sel.split(",") if s] or HEADLINE)

    # warm-up, not timed: JVM code paths and the Python worker pool (one trivial Arrow UDF)
    from strata.operators.encode import hashed_bow
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    b.select(hashed_bow("text")).write.format("noop").mode("overwrite").save()

    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {times.get(name, 'ERROR')}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "spark": spark.version, "n_queries": len(times)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
