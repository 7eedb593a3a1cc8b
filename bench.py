"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetlens.catalog.queries import QUERIES  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_machine_balance", "count_by_axis", "count_by_partition", "min_max_keys", "containers_backups_only",
    "filter_common", "instances_stateful", "instance_label", "container_report", "jvm_report", "best_containers",
    "relocation_target", "candidate_counts", "host_drain", "demote_plan", "bad_service_actions", "rolling_schedule",
    "parallel_waves", "effective_config", "duration_parse", "properties_read", "descriptor_read", "readiness_batch",
    "readiness_stream", "imbalance_windowed", "imbalance_stream", "rebalance_checks", "rebalance_step",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
         "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # starts the JVM and the Parquet reader, not counted
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
