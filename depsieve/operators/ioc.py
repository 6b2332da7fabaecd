"""Known-compromised versions and indicator dependencies.

No join here carries a broadcast hint: the indicator tables are broadcast by Spark
when their size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled,
with skew handling, when it is not.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.operators.lockfiles import lock_entries
from depsieve.operators.names import fits
from depsieve.rules import LOCKFILE_NAMES
from depsieve.schemas import alert_rows, details

BROADCAST_PROJECTS = 100_000
_INFO = ("incident", "date", "description", "malicious_dependencies", "references")


def first_known_bad(known_bad: DataFrame) -> DataFrame:
    """One row per (package, version): the entry that comes first in the table.

    Entries without a place (``entry_ord`` null or no such column) come last, in the order
    of their content.
    """
    info = F.struct(*_INFO)
    placed = F.col("entry_ord") if "entry_ord" in known_bad.columns else F.lit(None).cast("long")
    order = F.struct(placed.isNull().alias("unplaced"), placed.alias("place"), F.to_json(info).alias("content"))
    return (
        known_bad.groupBy("package", "version")
        .agg(F.min_by(info, order).alias("info"))
        .select("package", "version", "info.*")
    )


def ioc_dependencies(known_bad: DataFrame) -> DataFrame:
    """Names of all malicious dependencies, each once."""
    return known_bad.select(F.explode("malicious_dependencies").alias("package")).distinct()


def _at(package: str = "package", version: str = "version") -> Column:
    return F.concat(F.col(package), F.lit("@"), F.col(version))


def known_bad_matches(entries: DataFrame, known_bad: DataFrame) -> DataFrame:
    bad = first_known_bad(known_bad).select("package", "version", "incident")
    reason = F.concat(
        F.lit("Known-compromised version "), _at(), F.lit(" found in "), F.col("file_name"),
        F.lit(" ("), F.col("incident"), F.lit(")"),
    )
    return entries.join(bad, ["package", "version"]).select(*entries.columns, reason.alias("reason"))


def ioc_dependency_matches(entries: DataFrame, ioc_deps: DataFrame) -> DataFrame:
    reason = F.concat(
        F.lit("IOC dependency "), _at(), F.lit(" found in "), F.col("file_name"),
        F.lit(" — associated with a known supply chain incident"),
    )
    return entries.join(ioc_deps, "package", "left_semi").select(*entries.columns, reason.alias("reason"))


def indicators(known_bad: DataFrame) -> DataFrame:
    """(package, bad, is_ioc): its bad versions with their incident, and whether it is an
    indicator dependency; one row per package of either kind."""
    bad = first_known_bad(known_bad).select("package", F.struct("version", "incident").alias("bad"), F.lit(False).alias("ioc"))
    ioc = ioc_dependencies(known_bad).withColumn("ioc", F.lit(True))
    both = bad.unionByName(ioc, allowMissingColumns=True)
    return both.groupBy("package").agg(F.collect_list("bad").alias("bad"), F.max("ioc").alias("is_ioc"))


def lockfile_matches(lockfiles: DataFrame, known_bad: DataFrame, nested: str = "path") -> DataFrame:
    """All matches of the lockfile entries: known-bad versions (kind 0), then IOC names (1).

    One inner join by package with the merged indicators, so entries without any drop out
    there and no hot library of every lockfile is carried along.
    """
    entries = lock_entries(lockfiles, nested)
    found_in = F.concat(_at(), F.lit(" found in "), F.col("file_name"))
    match = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    known = F.transform(
        F.filter("bad", lambda b: b["version"] == F.col("version")),
        lambda b: match(0, F.concat(F.lit("Known-compromised version "), found_in, F.lit(" ("), b["incident"], F.lit(")"))),
    )
    related = F.when(
        F.col("is_ioc"),
        F.array(match(1, F.concat(F.lit("IOC dependency "), found_in, F.lit(" — associated with a known supply chain incident")))),
    )
    none = F.array().cast("ARRAY<STRUCT<kind: INT, reason: STRING>>")
    return entries.join(indicators(known_bad), "package").select(
        *entries.columns, F.inline(F.concat(known, F.coalesce(related, none)))
    )


def lockfile_alerts(lockfiles: DataFrame, known_bad: DataFrame, nested: str = "path") -> DataFrame:
    """One high alert per match, with its project; ordered by file kind, entry, match kind."""
    matches = lockfile_matches(lockfiles, known_bad, nested)
    kind = F.lit(0)
    for i, name in enumerate(LOCKFILE_NAMES):
        kind = F.when(F.col("file_name") == name, i).otherwise(kind)
    alert_ord = kind.cast("long") * (1 << 40) + F.col("ord") * 2 + F.col("kind")
    detail = details(file=F.col("path"), package=F.col("package"), version=F.col("version"))
    return alert_rows(
        matches, "lockfile_match", "high", F.col("reason"), detail, alert_ord=alert_ord, keep=("project",)
    )


def unavailable_requests(requests: DataFrame, registry_index: DataFrame) -> DataFrame:
    """Requests for versions the registry no longer has."""
    return requests.join(registry_index.select("package", "version"), ["package", "version"], "left_anti")


def known_compromised_alerts(
    requests: DataFrame, registry_index: DataFrame, known_bad: DataFrame, include_available: bool = False
) -> DataFrame:
    """Requested versions that are known to be bad and gone (or, as an option, not gone).

    A ``project`` column of the requests is kept.
    """
    asked = requests if include_available else unavailable_requests(requests, registry_index)
    keep = tuple(c for c in ("project",) if c in requests.columns)
    asked = asked.select(*keep, "package", "version").distinct()
    hits = asked.join(first_known_bad(known_bad), ["package", "version"])
    none = F.array().cast("ARRAY<STRING>")
    detail = details(
        incident=F.col("incident"),
        date=F.col("date"),
        description=F.col("description"),
        malicious_dependencies=F.coalesce("malicious_dependencies", none),
        references=F.coalesce("references", none),
    )
    message = F.concat(_at(), F.lit(" is a known-compromised version that was removed from npm"))
    return alert_rows(hits, "known_compromised", "high", message, detail, keep=keep)


def incident_lockfile_alerts(
    incidents: DataFrame, lockfiles: DataFrame, known_bad: DataFrame, nested: str = "path"
) -> DataFrame:
    """Lockfile alerts of every project that asked for a known-compromised version.

    ``incidents`` are known-compromised alerts with their project. Each of them gets
    all lockfile alerts of its project, under the name and version it asked for.
    """
    asked = incidents.select("project", "package", "version").distinct()
    projects = asked.select("project").distinct()
    # Few projects: skip the other lockfiles unparsed. Many: join the alerts only, so
    # that lockfile texts are not shuffled either way.
    if fits(projects, BROADCAST_PROJECTS):
        lockfiles = lockfiles.join(F.broadcast(projects), "project", "left_semi")
    found = lockfile_alerts(lockfiles, known_bad, nested).drop("package", "version")
    return found.join(asked, "project").select(
        "project", "package", "version", *[c for c in found.columns if c != "project"]
    )
