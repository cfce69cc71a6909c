"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
Every query runs once to warm up and then twice; the faster run counts, and ``spread`` is the
slower run over the faster one.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siftworks.plans.registry import QUERIES  # noqa: E402
from siftworks.session import local_session  # noqa: E402

HEADLINE = (
    "scan_documents scan_pages scan_conversations scan_planted_all_rules scan_custom_rule scan_tree partition_covered "
    "findings_rollup history_findings history_dedup_redacted delta_lines scan_delta gitignore_coverage "
    "byte_range_cli hex_dump_rows detected_types scan_strings_documents overwrite_at_cli overwrite_range_gui "
    "insert_at_cli patch_hex coalesce_runs apply_runs edits_preview debounce_batch dest_collisions manifest_diff "
    "scan_stream debounce_stream"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
        QUERIES["scan_benchmark"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds, spread = {}, {}
        for name in names:
            runs = []
            for _ in range(3):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            seconds[name] = round(min(runs[1:]), 3)
            spread[name] = round(max(runs[1:]) / min(runs[1:]), 2)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
