
from __future__ import annotations

import os
import sys
from collections.abc import Callable

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the library too, wherever the driver was started.
if HERE not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpora  # noqa: E402
import depsieve as ds  # noqa: E402
import oracles  # noqa: E402
from depsieve.operators.content import plain_rule  # noqa: E402
from depsieve.operators.files import in_walk  # noqa: E402
from depsieve.schemas import ALERT_COLUMNS, details  # noqa: E402
from depsieve.session import materialize, new_folder  # noqa: E402
from depsieve.streaming.feed import drain_to_table  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_STREAM_SECONDS = 600


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.package_files(spark, sf)


def _joined(items: Column) -> Column:
    return F.concat_ws(" | ", items)


# --- sources and sinks -----------------------------------------------------------


def ingest_archives(spark, sf):
    rows = ds.ingest_archives(spark, corpora.land_archives(spark, sf))
    return rows.where(F.col("content_error").isNull()).select("package", "version", "path", "content")


def read_package_tree(spark, sf):
    return ds.read_package_tree(spark, corpora.land_tree(spark, sf)).select("package", "version", "path", "content")


def source_files(spark, sf):
    files = _files(spark, sf).select("package", "version", "path")
    walks = ("hidden_pruned", "git_pruned")
    both = F.filter(
        F.array(*[F.when(in_walk(F.col("path"), w), F.lit(w)) for w in walks]), lambda w: w.isNotNull()
    )
    return files.select(F.explode(both).alias("walk"), "package", "version", "path")


def read_manifests(spark, sf):
    good = corpora.manifests(spark, sf).withColumnRenamed("manifest", "content").withColumn("path", F.lit("package.json"))
    deeper = good.withColumn("path", F.lit("lib/package.json"))
    broken = good.select(
        F.concat("package", F.lit("-broken")).alias("package"), "version", "path", F.expr("left(content, length(content) - 1)").alias("content")
    )
    return ds.read_manifests(good.unionByName(deeper).unionByName(broken))


def declared_dependencies(spark, sf):
    return ds.declared_dependencies(corpora.dependency_manifests(spark, sf))


def read_lockfiles(spark, sf):
    rows = ds.read_lockfiles(spark, corpora.land_lockfiles(spark, sf))
    return rows.select("project", "file_name", "kind_ord", "path")


def _popular(spark, sf):
    downloads = corpora.names(spark, sf).withColumn("downloads", F.lit(1).cast("long"))
    return ds.popular_packages(spark, downloads, 200)


def known_bad_table(spark, sf):
    folder = new_folder(spark, "incidents")
    corpora.known_bad_feed(spark, sf).write.json(folder)
    return ds.known_bad_table(spark, folder).select(
        "package", "version", "incident", "date",
        F.col("malicious_dependencies")[0].alias("malicious_dependency"), "description",
    )


def ioc_dependencies(spark, sf):
    return ds.ioc_dependencies(corpora.known_bad(spark, sf))


def write_alerts(spark, sf):
    folder = new_folder(spark, "alerts")
    ds.write_alerts(ds.filesystem_alerts(_files(spark, sf)), folder)
    return ds.read_alerts(spark, folder, ("filesystem_access",)).where(
        F.col("scanned_at").isNotNull() & (F.col("part") == 0)
    ).select("package", "version", "alert_type", "severity", F.col("details.count").alias("n"))


# --- content detectors -----------------------------------------------------------


def match_patterns(spark, sf):
    rules = [plain_rule("[A-Za-z]+ion"), plain_rule(r"\d{3,}")]
    return ds.match_patterns(ds.source_files(_files(spark, sf)), rules)


def shell_string_hits(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("package"),
        F.lit("1.0.0").alias("version"),
        F.lit("page.js").alias("path"),
        F.col("html").alias("content"),
    )
    return ds.shell_string_hits(_files(spark, sf).select(*pages.columns).unionByName(pages))


def char_entropy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"
    )
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return ds.char_entropy(docs.unionByName(pages), ["source", "id"], "text").withColumn(
        "entropy", F.round("entropy", 6)
    )


def install_scripts(spark, sf):
    return ds.install_scripts(corpora.manifests(spark, sf)).select(
        "package", "version", F.explode("scripts").alias("name", "command")
    )


# --- roll-ups --------------------------------------------------------------------


def network_alerts(spark, sf):
    return ds.network_alerts(_files(spark, sf)).select(
        "package", "version", "severity", "message",
        _joined(F.col("details.patterns")).alias("patterns"), F.col("details.count").alias("n"),
    )


def filesystem_alerts(spark, sf):
    return ds.filesystem_alerts(_files(spark, sf)).select(
        "package", "version", "severity", "message",
        F.explode("details.patterns").alias("pattern"), F.col("details.count").alias("n"),
    )


def shell_alerts(spark, sf):
    return ds.shell_alerts(_files(spark, sf)).select(
        "package", "version", "severity", "message",
        _joined(F.col("details.patterns")).alias("patterns"), F.col("details.count").alias("n"),
    )


def obfuscation_alerts(spark, sf):
    return ds.obfuscation_alerts(_files(spark, sf)).select(
        "package", "version", "severity", "message",
        F.col("details.threshold").alias("threshold"), F.inline("details.files"),
    )


def _script_text(scripts: Column) -> Column:
    return F.concat_ws("|", F.transform(F.map_entries(scripts), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def install_script_alerts(spark, sf):
    return ds.install_script_alerts(corpora.manifests(spark, sf)).select(
        "package", "version", "severity", "message", _script_text(F.col("details.scripts")).alias("scripts")
    )


# --- names -----------------------------------------------------------------------


def _popular_table(spark, sf):
    return materialize(_popular(spark, sf), "popular")


def typosquat_pairs(spark, sf):
    return ds.typosquat_pairs(corpora.names(spark, sf), _popular_table(spark, sf))


def typosquat_pairs_blocked(spark, sf):
    return ds.typosquat_pairs_blocked(corpora.names(spark, sf), _popular_table(spark, sf))


def typosquat_alerts(spark, sf):
    alerts = ds.typosquat_alerts(typosquat_pairs(spark, sf))
    one = lambda m: F.concat_ws(
        ":", m["package"], m["distance"].cast("string"), F.round(m["similarity"] * 100).cast("int").cast("string")
    )
    return alerts.select(
        "package", "severity", "message",
        F.concat_ws("|", F.transform("details.suspicious_matches", one)).alias("matches"),
    )


# --- lockfiles and indicators ----------------------------------------------------

_ENTRY = ("project", "file_name", "package", "version")


def npm_lock_entries(spark, sf):
    return ds.npm_lock_entries(corpora.lockfiles(spark, sf, ("package-lock.json",))).select(*_ENTRY)


def yarn_lock_entries(spark, sf):
    return ds.yarn_lock_entries(corpora.lockfiles(spark, sf, ("yarn.lock",))).select(*_ENTRY)


def pnpm_lock_entries(spark, sf):
    return ds.pnpm_lock_entries(corpora.lockfiles(spark, sf, ("pnpm-lock.yaml",))).select(*_ENTRY)


def leaf_lock_entries(spark, sf):
    return ds.leaf_lock_entries(corpora.nested_lockfiles(spark, sf)).select(*_ENTRY)


def known_bad_matches(spark, sf):
    entries = ds.lock_entries(corpora.lockfiles(spark, sf))
    return ds.known_bad_matches(entries, corpora.known_bad(spark, sf)).select(*_ENTRY, "reason")


def ioc_dependency_matches(spark, sf):
    entries = ds.lock_entries(corpora.lockfiles(spark, sf))
    deps = ds.ioc_dependencies(corpora.known_bad(spark, sf))
    return ds.ioc_dependency_matches(entries, deps).select(*_ENTRY, "reason")


def lockfile_alerts(spark, sf):
    place = F.row_number().over(Window.partitionBy("project").orderBy("alert_ord"))
    return ds.lockfile_alerts(corpora.lockfiles(spark, sf), corpora.known_bad(spark, sf)).select(
        "project", "package", "version", "alert_type", "severity", "message",
        F.col("details.file").alias("file"), place.alias("place"),
    )


def _requests(spark, sf):
    return corpora.derived(spark, sf, corpora.REQUESTS)


def _registry(spark, sf):
    return corpora.derived(spark, sf, corpora.REGISTRY)


def unavailable_requests(spark, sf):
    return ds.unavailable_requests(_requests(spark, sf), _registry(spark, sf)).select("project", "package", "version")


def _incidents(spark, sf):
    return ds.known_compromised_alerts(_requests(spark, sf), _registry(spark, sf), corpora.known_bad(spark, sf))


def known_compromised_alerts(spark, sf):
    return _incidents(spark, sf).select(
        "project", "package", "version", "severity", "message", "details.incident", "details.date",
        "details.description", F.col("details.malicious_dependencies")[0].alias("malicious_dependency"),
    )


def incident_lockfile_alerts(spark, sf):
    alerts = ds.incident_lockfile_alerts(_incidents(spark, sf), corpora.lockfiles(spark, sf), corpora.known_bad(spark, sf))
    return alerts.select(
        "project", "package", "version", "message",
        F.col("details.package").alias("locked_package"), F.col("details.version").alias("locked_version"),
    )


# --- scan and reports ------------------------------------------------------------


def _scan(spark, sf, **more) -> DataFrame:
    files = _files(spark, sf)
    versions = files.select("package", "version").distinct()
    return ds.scan_packages(
        files, versions, ds.popular_packages(spark), manifests=corpora.manifests(spark, sf), **more
    )


def _stored_scan(spark, sf) -> DataFrame:
    return materialize(_scan(spark, sf), "scan")


def scan_packages(spark, sf):
    patterns = F.when(F.col("details.patterns").isNotNull(), _joined(F.col("details.patterns")))
    scripts = F.when(F.col("details.scripts").isNotNull(), _script_text(F.col("details.scripts")))
    return _scan(spark, sf).where(F.col("part") == 0).select(
        "package", "version", "alert_type", "severity", "message", "detector_ord",
        F.coalesce(patterns, scripts).alias("detail"), F.col("details.count").alias("n"),
    )


def _results(spark, sf) -> DataFrame:
    return ds.scan_results(_stored_scan(spark, sf), _files(spark, sf).select("package", "version").distinct())


def scan_results(spark, sf):
    first = F.filter("alerts", lambda a: a["part"] == 0)
    return _results(spark, sf).select(
        "package", "version", F.size(first).cast("long").alias("alert_count"),
        F.concat_ws(",", F.transform(first, lambda a: a["alert_type"])).alias("alert_types"),
        F.col("scanned_at").isNotNull().alias("stamped"),
    )


def order_by_severity(spark, sf):
    alerts = ds.order_by_severity(_stored_scan(spark, sf)).where(F.col("part") == 0)
    place = F.row_number().over(
        Window.partitionBy("package", "version").orderBy("severity_ord", "detector_ord", "alert_ord")
    )
    return alerts.select("package", "version", "alert_type", "severity", place.alias("place"))


def scan_summary(spark, sf):
    return ds.scan_summary(_results(spark, sf))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("package", "version", "detector_ord", "line_no", "line")


def annotation_rows(spark, sf):
    return _lines(ds.annotation_rows(_stored_scan(spark, sf)))


def plain_report_rows(spark, sf):
    return _lines(ds.plain_report_rows(_stored_scan(spark, sf)))


def gate(spark, sf):
    alerts = ds.lockfile_alerts(corpora.lockfiles(spark, sf), corpora.known_bad(spark, sf))
    projects = corpora.derived(spark, sf, corpora.LOCK_PAIRS).select("project")
    return ds.gate(alerts, projects, "high")


def extra_detectors(spark, sf):
    def long_file(files: DataFrame) -> DataFrame:
        big = files.where(F.length("content") > 20000).select("package", "version").distinct()
        return big.select(
            "package", "version", F.lit(0).alias("detector_ord"), F.lit(0).cast("long").alias("alert_ord"),
            F.lit(0).alias("part"), F.lit("long_file").alias("alert_type"), F.lit("low").alias("severity"),
            F.lit("Package has a very long file").alias("message"), details().alias("details"),
        ).select(*ALERT_COLUMNS)

    found = _scan(spark, sf, extra_detectors=[long_file])
    return found.where(F.col("part") == 0).select("package", "version", "alert_type", "detector_ord")


# --- feed ------------------------------------------------------------------------


def _changes(spark, sf) -> DataFrame:
    return ds.read_changes(spark, corpora.land_changes(spark, sf))


def _drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything landed and read what it wrote."""
    spark = stream.sparkSession
    out = new_folder(spark, label)
    query = drain_to_table(stream, out, new_folder(spark, f"{label}-state"))
    if not query.awaitTermination(_STREAM_SECONDS):
        query.stop()
        raise TimeoutError(f"stream {label} did not finish")
    return spark.read.schema(stream.schema).parquet(out)


def read_changes(spark, sf):
    return _drained(_changes(spark, sf), "changes-table").select(
        "seq", "deleted", F.col("doc.name").alias("package"), F.col("doc.`dist-tags`.latest").alias("version")
    )


def publications(spark, sf):
    return _drained(ds.publications(_changes(spark, sf)), "publications").select("seq", "package", "version")


def resume_from_seq(spark, sf):
    half = spark.read.parquet(f"{sf}/events.parquet").count() / 2
    stream = ds.publications(ds.resume_from_seq(_changes(spark, sf), int(half)))
    return _drained(stream, "resumed").select("seq", "package", "version")


def dedupe_publications(spark, sf):
    stream = ds.dedupe_publications(ds.publications(_changes(spark, sf)), "3650 days")
    return _drained(stream, "deduped").select("package", "version")


def quarantine(spark, sf):
    published = _drained(ds.publications(_changes(spark, sf)), "published")
    good, bad = ds.quarantine(published, _files(spark, sf))
    return good.withColumn("reason", F.lit("ok")).unionByName(bad).select("seq", "package", "version", "reason")


def scan_stream(spark, sf):
    files = _files(spark, sf)

    def scan(batch: DataFrame) -> DataFrame:
        asked = batch.select("package", "version").distinct()
        return ds.filesystem_alerts(files).join(asked, ["package", "version"], "left_semi")

    out = new_folder(spark, "stream-alerts")
    stream = ds.publications(_changes(spark, sf))
    query = ds.scan_stream(stream, scan, out, new_folder(spark, "stream-state"), available_now=True)
    if not query.awaitTermination(_STREAM_SECONDS):
        query.stop()
        raise TimeoutError("the scan stream did not finish")
    alerts = spark.read.option("basePath", out).parquet(out).where(F.col("part") == 0)
    return alerts.select("package", "version", "alert_type", F.col("details.count").alias("n")).distinct()


# --- contract --------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Which package versions touch the filesystem, and by which calls?"""
    return filesystem_alerts(spark, "/root/testdata/sf0.001")


def _on_files(operator) -> Query:
    return lambda spark, sf: operator(_files(spark, sf))


def _llm():
    """The modules of the corpus-preparation operators, or none where that subpackage was left out."""
    try:
        import corpus_pipeline
        from depsieve.llm import queries as llm_queries
    except ModuleNotFoundError as error:
        if error.name in ("corpus_pipeline", "depsieve.llm"):
            return None
        raise
    return llm_queries, corpus_pipeline


def queries() -> dict[str, Query]:
    found = _own_queries()
    if llm := _llm():
        found |= llm[0].QUERIES | {"pipeline": llm[1].run}
    return found


def _own_queries() -> dict[str, Query]:
    return {
        "ingest_archives": ingest_archives,
        "read_package_tree": read_package_tree,
        "source_files": source_files,
        "read_manifests": read_manifests,
        "declared_dependencies": declared_dependencies,
        "read_lockfiles": read_lockfiles,
        "popular_packages": _popular,
        "known_bad_table": known_bad_table,
        "ioc_dependencies": ioc_dependencies,
        "write_alerts": write_alerts,
        "match_patterns": match_patterns,
        "filesystem_hits": _on_files(ds.filesystem_hits),
        "shell_hits": _on_files(ds.shell_hits),
        "shell_string_hits": shell_string_hits,
        "network_hits": _on_files(ds.network_hits),
        "network_structural_hits": _on_files(ds.network_structural_hits),
        "char_entropy": char_entropy,
        "obfuscated_files": _on_files(ds.obfuscated_files),
        "install_scripts": install_scripts,
        "network_alerts": network_alerts,
        "filesystem_alerts": filesystem_alerts,
        "shell_alerts": shell_alerts,
        "obfuscation_alerts": obfuscation_alerts,
        "install_script_alerts": install_script_alerts,
        "typosquat_pairs": typosquat_pairs,
        "typosquat_pairs_blocked": typosquat_pairs_blocked,
        "typosquat_alerts": typosquat_alerts,
        "npm_lock_entries": npm_lock_entries,
        "yarn_lock_entries": yarn_lock_entries,
        "pnpm_lock_entries": pnpm_lock_entries,
        "leaf_lock_entries": leaf_lock_entries,
        "known_bad_matches": known_bad_matches,
        "ioc_dependency_matches": ioc_dependency_matches,
        "lockfile_alerts": lockfile_alerts,
        "unavailable_requests": unavailable_requests,
        "known_compromised_alerts": known_compromised_alerts,
        "incident_lockfile_alerts": incident_lockfile_alerts,
        "scan_packages": scan_packages,
        "scan_results": scan_results,
        "order_by_severity": order_by_severity,
        "scan_summary": scan_summary,
        "annotation_rows": annotation_rows,
        "plain_report_rows": plain_report_rows,
        "gate": gate,
        "read_changes": read_changes,
        "publications": publications,
        "scan_stream": scan_stream,
        "resume_from_seq": resume_from_seq,
        "quarantine": quarantine,
        "dedupe_publications": dedupe_publications,
        "extra_detectors": extra_detectors,
    }


def oracle_sql() -> dict[str, str]:
    found = oracles.oracle_sql()
    if llm := _llm():
        found |= llm[0].ORACLE_SQL
        if llm[1].ORACLE_SQL:
            found["pipeline"] = llm[1].ORACLE_SQL
    return found
