"""Time the headline operations and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of local cores.  Every operation is timed from
plan building to the last row, with the result thrown away.  Before that it runs once on the smallest
tables beside the chosen ones, if there are any, so that class loading and code generation are not
what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sievework import registry
from sievework.session import build_session

HEADLINES = [
    "scorecard", "inspection", "before_after_scorecard", "table_profile", "repaired_items", "trust_history",
    "schema_fingerprint", "flagged_orders", "word_chunks", "char_chunks", "token_counts", "keyword_top", "dense_top",
    "dense_top_by_cells", "hybrid_search", "similarity_edges", "trimmed_conversations", "answer_critiques",
    "cost_summary", "gate_summary", "lesson_search", "latest_notes", "cache_outcomes", "payload_envelopes_stream",
    "running_usage_stream", "csv_round_trip",
]


def run(op: registry.Operation, spark, sf_dir: str) -> None:
    op.runner(spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.operations()
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    names = sys.argv[1:] or HEADLINES
    if os.path.isdir(warm_dir) and os.path.realpath(warm_dir) != os.path.realpath(sf_dir):
        for name in names:
            run(known[name], spark, warm_dir)

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(known[name], spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total seconds over headline operations", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
