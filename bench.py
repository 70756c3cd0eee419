"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rollweave.plans import full_catalog  # noqa: E402
from rollweave.session import local_session  # noqa: E402

HEADLINES = (
    "line_extract", "first_per_key", "cover_metadata", "parse_stats", "fanout_voter_records", "name_enrich",
    "fuzzy_search", "fuzzy_search_batch", "substring_search", "join_left", "roll_summary_by_state",
    "voter_summary", "quality_breakdown", "readiness_report", "readiness_by_part", "upsert_merge",
    "manifest_rules", "request_rules", "search_gate", "guidance_api", "guidance_web", "rate_limit",
    "sensitive_scan", "person_linkage", "cross_year_diff",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    catalog = full_catalog()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("fuzzy_search")  # starts the JVM's code paths; not counted
    times = {name: round(run(name), 3) for name in HEADLINES}
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
