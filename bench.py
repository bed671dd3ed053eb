"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import time

from fleetaudit import build_session
from fleetaudit.plans import registry

HEADLINES = os.environ.get("BENCH_QUERIES", "").split() or [
    "scorecard_category", "scorecard_overall", "severity_counts", "fingerprints", "merge_duplicates", "baseline_asof",
    "lifecycle", "audit_compare", "policy_apply", "gate", "change_risk", "fix_verdict", "compliance_controls", "portfolio",
    "risk_register", "secret_scan", "duplicate_blocks", "pinned_dependencies", "pins_vs_advisories", "dockerfile_rules",
    "import_cycles", "migration_issues", "bandit_report", "rate_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    spark.range(1).count()
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
