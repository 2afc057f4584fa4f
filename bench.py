"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of raw tables, BENCH_CPUS the number of local cores.
Each query is run to its last row without keeping the result. The derived
catalog tables are written first and timed as `derive_tables`; the other times
read them, as queries over an existing catalog would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stowage.datasets import Tables  # noqa: E402
from stowage.queries import registered  # noqa: E402
from stowage.session import local_session  # noqa: E402

HEADLINE = [
    "usage_rollup", "current_usage", "biggest_files", "subfolder_usage", "access_filter",
    "access_levels", "query_items", "list_one_level", "path_profile", "path_exists",
    "transfer_plan", "rename_plan", "delete_plan", "restore_plan", "storage_class_plan",
    "transfer_progress", "history_sample", "audit_statistics", "latest_pending", "grid_page",
    "grid_and", "preview", "top_lines", "chunk_manifest", "assemble_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    times: dict[str, float] = {}

    begin = time.perf_counter()
    tables = Tables(spark, folder)
    for build in (tables.drive_item, tables.memory_usage, tables.folder_files):
        build()
    times["derive_tables"] = round(time.perf_counter() - begin, 3)

    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
