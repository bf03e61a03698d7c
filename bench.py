"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loglake.plans.registered import QUERIES
from loglake.session import build_session

HEADLINE = (
    "histogram_hour", "histogram_by_file", "timeline_bounds", "search_text_all", "search_regex", "attrs_contains",
    "correlate_page", "correlate_total", "lexemes_documents", "terms_documents", "base_summary", "full_summary",
    "sessions_events", "highlight_first_rule", "highlight_markup", "datetime_roundtrip_wls12h", "parse_access_roundtrip",
    "parse_weblogic_roundtrip", "parse_mixed_logs", "parse_documents", "assemble_records", "assemble_records_lines",
    "dedup_report", "storage_stats", "annotation_markers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "loglake-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["histogram_day"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
