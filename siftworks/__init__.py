"""Credential scanning, blob analysis and file-event streams as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions sent to executors travel with the helpers they call, so the
# package needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from siftworks.functions.rules import Rule, default_rules, rules_frame, select_rules, user_rule  # noqa: E402
from siftworks.functions.severity import LEVELS, parse_severity  # noqa: E402
from siftworks.operators.coverage import apply_gitignore, covered_paths, load_gitignore_rules  # noqa: E402
from siftworks.operators.delta import delta_lines  # noqa: E402
from siftworks.operators.history import scan_history  # noqa: E402
from siftworks.operators.match import explode_lines, match_rules, scan_text  # noqa: E402
from siftworks.plans.scans import (  # noqa: E402
    ScanOptions,
    scan_delta,
    scan_directory,
    scan_files,
    scan_repository,
    scan_tree,
)
from siftworks.sources.readers import load_ignore_rules, read_tree  # noqa: E402

__all__ = [
    "LEVELS", "Rule", "ScanOptions", "apply_gitignore", "covered_paths", "default_rules", "delta_lines", "explode_lines",
    "load_gitignore_rules", "load_ignore_rules", "match_rules", "parse_severity", "read_tree", "rules_frame", "scan_delta",
    "scan_directory", "scan_files", "scan_history", "scan_repository", "scan_text", "scan_tree", "select_rules", "user_rule",
]
