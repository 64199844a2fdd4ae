"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Each query is counted once after a warm-up scan; the metric is the sum.
"""

from __future__ import annotations

import json
import os
import time

from tarnhelm.plans import all_plans
from tarnhelm.session import session

HEADLINE = (
    "detect_counts", "email_findings", "phone_findings", "card_luhn_valid", "redacted_stats", "structured_findings", "coalesce_findings", "nms_findings",
    "text_chunks", "propagate_repeats", "text_blocks", "html_blocks", "finding_blocks", "suggestion_merge", "overlay_commands", "edit_history",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")), "8g")
    queries = all_plans().queries
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
