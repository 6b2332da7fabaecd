"""Whole scans, results, reports and gates."""

import json

import pytest
from pyspark.sql import functions as F

import depsieve as ds
from depsieve.operators.rollups import pack_in_parts
from depsieve.schemas import ALERT_COLUMNS, alert_rows, details

KEY = "package STRING, version STRING"


@pytest.fixture(scope="module")
def corpus(make_files):
    noisy = "const { exec } = require('child_process'); exec('bash -c x'); fs.rm(a); fetch(u);"
    return make_files(
        ("reakt", "1.0.0", "index.js", noisy),
        ("reakt", "1.0.0", "package.json", json.dumps({"scripts": {"postinstall": "node x.js"}})),
        ("clean", "1.0.0", "index.js", "const a = 1;"),
        ("unasked", "1.0.0", "index.js", noisy),
    )


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([("reakt", "1.0.0"), ("clean", "1.0.0"), ("axios", "1.14.1"), ("reakt", "1.0.0")], KEY)


@pytest.fixture(scope="module")
def alerts(spark, corpus, requests):
    registry = spark.createDataFrame([("reakt", "1.0.0"), ("clean", "1.0.0")], KEY)
    return ds.scan_packages(
        corpus, requests, ds.popular_packages(spark), registry_index=registry, known_bad=ds.known_bad_table(spark)
    ).persist()


def test_fixed_detector_order(alerts):
    rows = alerts.where("package = 'reakt'").orderBy("detector_ord").collect()
    assert [r.alert_type for r in rows] == ["install_script", "network_access", "typosquat", "filesystem_access", "shell_access"]
    others = {(r.package, r.alert_type) for r in alerts.where("package <> 'reakt'").collect()}
    assert others == {("axios", "known_compromised")}


def test_many_requests_give_the_same_alerts(spark, corpus, requests, alerts, monkeypatch):
    monkeypatch.setattr("depsieve.plans.scan.BROADCAST_REQUESTS", 0)
    registry = spark.createDataFrame([("reakt", "1.0.0"), ("clean", "1.0.0")], KEY)
    again = ds.scan_packages(
        corpus, requests, ds.popular_packages(spark), registry_index=registry, known_bad=ds.known_bad_table(spark)
    )
    flat = lambda df: sorted(r.asDict(True).__repr__() for r in df.collect())
    assert flat(again) == flat(alerts)


def test_results_have_every_request(alerts, requests):
    rows = ds.scan_results(alerts, requests).collect()
    assert sorted((r.package, len(r.alerts)) for r in rows) == [("axios", 1), ("clean", 0), ("reakt", 5), ("reakt", 5)]
    assert all(r.scanned_at for r in rows)
    reakt = next(r for r in rows if r.package == "reakt")
    assert [a.detector_ord for a in reakt.alerts] == [1, 2, 3, 4, 6]
    assert json.loads(reakt.alerts[0].details_json)["scripts"] == {"postinstall": "node x.js"}


def test_summary(alerts, requests):
    rows = {r.package: (r.alert_count, r.status, r.headline) for r in ds.scan_summary(ds.scan_results(alerts, requests.distinct())).collect()}
    assert rows == {
        "reakt": (5, "WARN", "5 ALERTS FOUND"),
        "clean": (0, "PASS", "NO THREATS DETECTED"),
        "axios": (1, "WARN", "1 ALERT FOUND"),
    }


def test_severity_order(alerts):
    rows = ds.order_by_severity(alerts).where("package = 'reakt'").collect()
    assert [r.severity for r in rows] == ["high", "high", "high", "medium", "medium"]
    assert [r.detector_ord for r in rows] == [1, 3, 6, 2, 4]


def test_project_scan_with_lockfiles(spark, corpus):
    asked = spark.createDataFrame([("p", "axios", "1.14.1"), ("q", "reakt", "1.0.0"), ("r", "reakt", "1.0.0")], f"project STRING, {KEY}")
    registry = spark.createDataFrame([("reakt", "1.0.0")], KEY)
    lock = 'plain-crypto-js@^4:\n  version "4.2.1"\n'
    locks = spark.createDataFrame([("p", "p/yarn.lock", "yarn.lock", lock), ("q", "q/yarn.lock", "yarn.lock", lock)], "project STRING, path STRING, file_name STRING, content STRING")
    found = ds.scan_packages(
        corpus, asked, ds.popular_packages(spark), registry_index=registry, known_bad=ds.known_bad_table(spark), lockfiles=locks
    )
    results = {r.project: [a.alert_type for a in r.alerts] for r in ds.scan_results(found, asked).collect()}
    assert results["p"] == ["known_compromised", "lockfile_match"]
    assert results["q"] == results["r"] and len(results["q"]) == 5


def test_extra_detector(spark, corpus, requests):
    def readme(files):
        rows = files.where(F.col("content").contains("const a")).select("package", "version").distinct()
        return alert_rows(rows, "boring", "low", "Boring code", details())

    found = ds.scan_packages(corpus, requests, ds.popular_packages(spark), extra_detectors=[readme])
    rows = found.where("alert_type = 'boring'").collect()
    assert [(r.package, r.severity, r.detector_ord) for r in rows] == [("clean", "low", 100)]
    assert tuple(found.columns) == ALERT_COLUMNS


# --- reports ---------------------------------------------------------------------


def lines(df, alert_type_ord):
    return [r.line for r in df.where(F.col("detector_ord") == alert_type_ord).orderBy("line_no").collect()]


def test_annotations(alerts):
    rows = ds.annotation_rows(alerts)
    assert lines(rows, 1) == [
        "::error::INSTALL SCRIPT: Package contains install scripts: postinstall",
        "::error::Scripts: postinstall",
    ]
    assert lines(rows, 2) == [
        "::warning::NETWORK ACCESS: Package makes network requests",
        "::warning::Detected patterns: Regex match: fetch\\s*\\(, Global: fetch, Call: fetch()",
    ]
    assert lines(rows, 3) == ['::error::TYPOSQUAT: Potential typosquat of popular package "react" (distance: 1)']
    assert lines(rows, 7)[1:] == [
        "::error::Incident: Axios npm supply chain compromise (2025-03-26)",
        "::error::Attacker published malicious versions that inject plain-crypto-js to steal credentials and environment variables. Versions were unpublished by npm after detection.",
        "::error::IOC dependencies: plain-crypto-js",
    ]


def test_plain_report(spark, alerts, tmp_path):
    rows = ds.plain_report_rows(alerts)
    assert lines(rows, 1) == [
        "", "=" * 60, "[HIGH] INSTALL SCRIPT", "Package contains install scripts: postinstall", "", "Scripts found:",
        "  - postinstall: node x.js", "=" * 60,
    ]
    many = alert_rows(
        spark.createDataFrame([("p", "1")], KEY), "shell_access", "high", "m",
        details(patterns=F.array(*[F.lit(f"x{i}") for i in range(8)]), count=F.lit(20)),
    )
    assert lines(ds.plain_report_rows(many), 6)[-3:] == ["  - x4", "  ... and 3 more", "=" * 60]
    ds.write_report(rows, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == rows.count()


def test_lockfile_report_line(spark):
    found = alert_rows(spark.createDataFrame([("p", "1")], KEY), "lockfile_match", "high", "m", details(file=F.lit("p/yarn.lock")))
    assert lines(ds.annotation_rows(found), 8) == ["::error::LOCKFILE MATCH: m", "::error::Found in: p/yarn.lock"]


def test_gate(spark):
    rows = spark.createDataFrame([("a", "high", 0), ("a", "medium", 0), ("b", "medium", 0), ("a", "high", 1)], "project STRING, severity STRING, part INT")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "project STRING")
    run = lambda level: {r.project: (r.alert_count, r.status) for r in ds.gate(rows, groups, level).collect()}
    assert run("low") == {"a": (2, "FAIL"), "b": (1, "FAIL"), "c": (0, "PASS")}
    assert run("high") == {"a": (2, "FAIL"), "b": (1, "PASS"), "c": (0, "PASS")}


# --- large groups ----------------------------------------------------------------


def test_parts_keep_every_row(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4990, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.when(F.col("id") >= 0, F.struct("id")).alias("item"),
    )
    packed = pack_in_parts(rows, ["k"], "item", limit=100).collect()
    hot = [r for r in packed if r.k == "hot"]
    assert sorted(i.id for r in hot for i in r["items"]) == list(range(4990))
    assert {r.total for r in hot} == {4990} and len({r.part for r in hot}) == len(hot) > 30
    assert max(len(r["items"]) for r in hot) < 250
    assert all([i.id for i in r["items"]] == sorted(i.id for i in r["items"]) for r in hot)
    assert all((r.part, r.total) == (0, 1) for r in packed if r.k != "hot")


def test_alert_in_parts(make_files, monkeypatch):
    code = "\n".join(f"import a{i} from 'fs'" for i in range(300))
    monkeypatch.setattr(pack_in_parts, "__defaults__", (50,))
    parts = ds.filesystem_alerts(make_files(("a.js", code), ("q", "1", "b.js", "fs.rm(x)"))).collect()
    big = [r for r in parts if r.package == "p"]
    assert len({p for r in big for p in r.details.patterns}) == 300
    assert {r.details["count"] for r in big} == {300} and sorted(r.part for r in big) == list(range(len(big)))
    assert [r.details["count"] for r in parts if r.package == "q"] == [1]


def test_parts_are_ranges_of_the_order(spark):
    rows = spark.createDataFrame(
        [("hot", f"i{n:05d}") for n in range(3000)] + [(f"k{n}", "x") for n in range(30)] + [(None, "y")], "k STRING, item STRING"
    )
    for limit in (70, 1000, 5000):
        packed = pack_in_parts(rows, ["k"], "item", limit=limit).collect()
        hot = sorted((r for r in packed if r.k == "hot"), key=lambda r: r.part)
        assert [r.part for r in hot] == list(range(-(-3000 // limit)))
        assert [i for r in hot for i in r["items"]] == [f"i{n:05d}" for n in range(3000)]
        assert all(len(r["items"]) <= limit for r in packed)
        assert {r.k for r in packed} == {"hot", None, *(f"k{n}" for n in range(30))}


def test_first_report_lines_do_not_depend_on_the_number_of_hits(make_files):
    for count in (40, 1500):
        code = "\n".join(f"fs.rm(a{n:05d}); import b{n:05d} from 'fs'" for n in range(count))
        alerts = ds.filesystem_alerts(make_files(("a.js", code)))
        lines = [r.asDict() for r in ds.annotation_rows(alerts).collect()]
        assert any("import b00000 from 'fs'" in str(x) for x in lines), lines
        assert any("import b00002 from 'fs'" in str(x) for x in lines)
        assert not any("import b00007 from 'fs'" in str(x) for x in lines)


def test_summary_is_by_project(spark):
    requests = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("b", "q", "1")], "project STRING, package STRING, version STRING")
    alerts = ds.install_script_alerts(
        spark.createDataFrame([("p", "1", '{"scripts": {"install": "x"}}')], "package STRING, version STRING, manifest STRING")
    ).withColumn("project", F.lit(None).cast("string"))
    found = {(r.project, r.package): r.headline for r in ds.scan_summary(ds.scan_results(alerts, requests)).collect()}
    assert found == {("a", "p"): "1 ALERT FOUND", ("b", "p"): "1 ALERT FOUND", ("b", "q"): "NO THREATS DETECTED"}
