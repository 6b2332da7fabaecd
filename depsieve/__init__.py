"""Package supply-chain analytics on Spark: DataFrames in, one alert table out."""

import sys

from pyspark import cloudpickle

from depsieve.operators.content import (
    filesystem_hits,
    match_patterns,
    network_hits,
    network_structural_hits,
    shell_hits,
    shell_string_hits,
)
from depsieve.operators.files import source_files
from depsieve.operators.install import declared_dependencies, install_script_alerts, install_scripts
from depsieve.operators.ioc import (
    incident_lockfile_alerts,
    ioc_dependencies,
    ioc_dependency_matches,
    known_bad_matches,
    known_compromised_alerts,
    lockfile_alerts,
    lockfile_matches,
    unavailable_requests,
)
from depsieve.operators.lockfiles import (
    leaf_lock_entries,
    lock_entries,
    npm_lock_entries,
    pnpm_lock_entries,
    yarn_lock_entries,
)
from depsieve.operators.names import typosquat_alerts, typosquat_pairs, typosquat_pairs_blocked
from depsieve.operators.rollups import (
    char_entropy,
    distinct_hits,
    file_hits,
    filesystem_alerts,
    network_alerts,
    obfuscated_files,
    obfuscation_alerts,
    shell_alerts,
)
from depsieve.plans.report import annotation_rows, plain_report_rows, write_report
from depsieve.plans.scan import (
    content_alerts,
    gate,
    order_by_severity,
    scan_packages,
    scan_results,
    scan_summary,
)
from depsieve.session import configure, local_session
from depsieve.sources.alert_table import read_alerts, write_alerts
from depsieve.sources.lockfile_texts import read_lockfiles
from depsieve.sources.packages import ingest_archives, read_manifests, read_package_tree, unpack_archives
from depsieve.sources.reference_lists import known_bad_table, popular_packages
from depsieve.streaming.feed import (
    dedupe_publications,
    publications,
    quarantine,
    read_changes,
    resume_from_seq,
    scan_stream,
)

# Ship the few Python helpers with the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
