"""A whole scan: all detectors over all requested versions, in one job."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.operators.content import FAMILIES, INSTALL
from depsieve.operators.install import install_script_alerts
from depsieve.operators.ioc import incident_lockfile_alerts, known_compromised_alerts
from depsieve.operators.names import fits, typosquat_alerts, typosquat_pairs
from depsieve.operators.rollups import (
    distinct_hits,
    file_hits,
    filesystem_alerts,
    manifest_script_alerts,
    network_alerts,
    obfuscation_alerts,
    pack_in_parts,
    shell_alerts,
)
from depsieve.rules import ENTROPY_THRESHOLD
from depsieve.schemas import ALERT_COLUMNS, EXTRA_DETECTOR_ORD
from depsieve.session import materialize

Detector = Callable[[DataFrame], DataFrame]
BROADCAST_REQUESTS = 500_000


def content_alerts(
    files: DataFrame, threshold: float = ENTROPY_THRESHOLD, with_manifests: bool = False
) -> DataFrame:
    """Alerts of the content detectors from a single pass over the files.

    The distinct hits (tiny next to the contents) are written to the shared folder by
    family; each detector then reads its own part. ``with_manifests`` adds install
    scripts, from the manifests among the files.
    """
    families = (*FAMILIES, INSTALL) if with_manifests else FAMILIES
    found = distinct_hits(file_hits(files, families, threshold))
    hits = materialize(found, "hits", ("family",))
    alerts = (
        network_alerts(hits)
        .unionByName(filesystem_alerts(hits))
        .unionByName(obfuscation_alerts(hits, threshold))
        .unionByName(shell_alerts(hits))
    )
    return alerts.unionByName(manifest_script_alerts(hits)) if with_manifests else alerts


def scan_packages(
    files: DataFrame,
    requests: DataFrame,
    popular: DataFrame,
    manifests: DataFrame | None = None,
    registry_index: DataFrame | None = None,
    known_bad: DataFrame | None = None,
    lockfiles: DataFrame | None = None,
    extra_detectors: Sequence[Detector] = (),
    threshold: float = ENTROPY_THRESHOLD,
) -> DataFrame:
    """The alert table for all requested versions.

    Without ``manifests``, install scripts come from the files' own root manifests.

    Requested versions that the registry still has (all, without an index) go through
    the six detectors and any extra ones. With an index and a known-bad table, the ones
    that are gone are looked up there, and lockfiles of the asking projects are checked.
    Alerts on one version do not depend on how often it was requested.
    """
    key = ["package", "version"]
    asked = requests.select(*key).distinct()
    if registry_index is not None:
        asked = asked.join(registry_index.select(*key), key, "left_semi")
    if fits(asked, BROADCAST_REQUESTS):
        # Few versions: drop other packages' files before any content is looked at.
        wanted = F.broadcast(asked)
        files = files.join(wanted, key, "left_semi")
        limit = lambda alerts: alerts
    else:
        # Many: contents stay where they are, and only the alerts are matched.
        limit = lambda alerts: alerts.join(asked, key, "left_semi").select(*ALERT_COLUMNS)
    found = content_alerts(files, threshold, with_manifests=manifests is None)
    if manifests is not None:
        found = found.unionByName(install_script_alerts(manifests.join(asked, key, "left_semi")))
    found = limit(found)
    found = found.unionByName(typosquat_alerts(typosquat_pairs(asked, popular), requests=asked))
    # Whatever the number of requests, a user's detector sees the files of requested versions only.
    asked_files = files.join(asked, key, "left_semi") if extra_detectors else files
    for i, detector in enumerate(extra_detectors):
        extra = detector(asked_files).withColumn("detector_ord", F.lit(EXTRA_DETECTOR_ORD + i))
        found = found.unionByName(limit(extra.select(*ALERT_COLUMNS)))
    by_project = "project" in requests.columns
    if by_project:
        found = found.withColumn("project", F.lit(None).cast("string"))
    if registry_index is not None and known_bad is not None:
        gone = known_compromised_alerts(requests.select(*key), registry_index, known_bad)
        found = found.unionByName(gone, allowMissingColumns=by_project)
        if lockfiles is not None and by_project:
            incidents = known_compromised_alerts(requests, registry_index, known_bad)
            found = found.unionByName(incident_lockfile_alerts(incidents, lockfiles, known_bad))
    return found


def severity_ord(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def order_by_severity(alerts: DataFrame) -> DataFrame:
    """High, medium, low; inside each in detector order."""
    return alerts.withColumn("severity_ord", severity_ord(F.col("severity"))).orderBy(
        "package", "version", "severity_ord", "detector_ord", "alert_ord", "part"
    )


def scan_results(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request with its alerts in order (none: an empty array) and the time.

    Alerts without a project belong to every project that asked for the version. A
    version with a very large number of alerts gets further rows, ``results_part`` 1
    and up; see ``pack_in_parts``. Details are JSON text inside the array.
    """
    key = [c for c in ("project", "package", "version") if c in requests.columns]
    if "project" in key:
        shared = alerts.where(F.col("project").isNull()).drop("project")
        asked = requests.select(*key).distinct()
        alerts = shared.join(asked, ["package", "version"]).unionByName(
            alerts.where(F.col("project").isNotNull())
        )
    alert = F.struct(
        "detector_ord", "alert_ord", "part", "alert_type", "severity", "message",
        F.to_json("details").alias("details_json"),
    )
    rows = alerts.select(*key, F.when(F.col("severity").isNotNull(), alert).alias("alert"))
    packed = pack_in_parts(rows, key, "alert").select(
        *key, F.col("part").alias("results_part"), F.col("items").alias("alerts")
    )
    none = F.array().cast(packed.schema["alerts"].dataType)
    return requests.join(packed, key, "left").select(
        *requests.columns,
        F.coalesce("results_part", F.lit(0)).alias("results_part"),
        F.coalesce("alerts", none).alias("alerts"),
        F.current_timestamp().alias("scanned_at"),
    )


def scan_summary(results: DataFrame) -> DataFrame:
    """Per result: how many alerts, and PASS or WARN with the headline."""
    first_parts = F.size(F.filter("alerts", lambda a: a["part"] == 0)).cast("long")
    key = [c for c in ("project", "package", "version") if c in results.columns]
    counted = results.groupBy(*key).agg(F.sum(first_parts).alias("alert_count"))
    n = F.col("alert_count")
    headline = F.when(n == 0, F.lit("NO THREATS DETECTED")).otherwise(
        F.concat(n.cast("string"), F.when(n > 1, " ALERTS FOUND").otherwise(" ALERT FOUND"))
    )
    return counted.select(
        *key,
        "alert_count",
        F.when(n == 0, "PASS").otherwise("WARN").alias("status"),
        headline.alias("headline"),
    )


def gate(alerts: DataFrame, groups: DataFrame, min_severity: str = "low", by: str = "project") -> DataFrame:
    """Pass or fail per group: any alert of at least ``min_severity`` fails it."""
    worst = {"high": 0, "medium": 1, "low": 2}[min_severity]
    counted = (
        alerts.where(F.col("part") == 0)
        .groupBy(by)
        .agg(
            F.count("severity").alias("alert_count"),
            F.count(F.when(severity_ord(F.col("severity")) <= worst, 1)).alias("failing_count"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (
        groups.select(by)
        .distinct()
        .join(counted, by, "left")
        .select(by, zero("alert_count"), zero("failing_count"))
        .withColumn("status", F.when(F.col("failing_count") > 0, "FAIL").otherwise("PASS"))
    )
