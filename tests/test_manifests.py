"""Install-time scripts and declared dependencies."""

import json

import pytest
from pyspark.sql import functions as F

import depsieve as ds


@pytest.fixture
def manifest(spark):
    def make(*texts):
        rows = [("p", str(i), t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "package STRING, version STRING, manifest STRING")

    return make


SIX = ["preinstall", "install", "postinstall", "preuninstall", "uninstall", "postuninstall"]


def test_install_scripts(manifest):
    (row,) = ds.install_script_alerts(manifest({"scripts": {"postinstall": "node b.js", "install": "node a.js", "x": "y"}})).collect()
    assert (row.alert_type, row.severity) == ("install_script", "high")
    assert row.message == "Package contains install scripts: install, postinstall"
    assert row.details.scripts == {"install": "node a.js", "postinstall": "node b.js"}


def test_safe_missing_and_invalid(manifest):
    texts = [
        {"scripts": {"test": "jest", "build": "tsc", "start": "node ."}}, {"name": "x"}, {"scripts": "install"},
        {"scripts": ["install"]}, {"scripts": None}, "not json", '{"scripts":{"install":"x"}} trailing', "[]", "null", "",
        '{"scripts":{"install":"x"}},{"a":1}', '{"scripts":{"install":"x"}',
    ]
    assert ds.install_script_alerts(manifest(*texts)).count() == 0


def test_all_six(manifest):
    alerts = ds.install_script_alerts(manifest({"scripts": {n: "x" for n in reversed(SIX)}}))
    (row,) = alerts.select("message", F.map_keys("details.scripts").alias("names")).collect()
    assert row.names == SIX
    assert row.message == "Package contains install scripts: " + ", ".join(SIX)


@pytest.mark.parametrize("value, kept", [('""', None), ("false", None), ("0", None), ("0.0", None), ("null", None), ("5", "5"), ("true", "true"), ('"0"', "0"), ("-0.5", "-0.5")])
def test_truthiness(manifest, value, kept):
    rows = ds.install_scripts(manifest('{"scripts":{"install":%s}}' % value)).collect()
    assert [r.scripts["install"] for r in rows] == ([kept] if kept else [])


def test_last_of_equal_keys_wins(manifest):
    (row,) = ds.install_scripts(manifest('{"scripts":{"install":"a","install":"b","x":{"a":1,"a":2}}}')).collect()
    assert row.scripts == {"install": "b"}
    text = '{"dependencies":{"a":"1","a":"2","b":"1"},"devDependencies":{"b":"3","b":"4"}}'
    rows = ds.declared_dependencies(manifest(text)).collect()
    assert sorted((r.package, r.version) for r in rows) == [("a", "2"), ("b", "4")]


def test_read_manifests(make_files):
    files = make_files(("package.json", '{"name":"a"}'), ("lib/package.json", "{}"), ("a.js", "{}"))
    assert [r.manifest for r in ds.read_manifests(files).collect()] == ['{"name":"a"}']
    assert ds.read_manifests(make_files(("package.json", "{oops"))).count() == 0


def test_declared_dependencies(manifest):
    text = {"dependencies": {"a": "^1.0.0", "b": "~2.0.0", "c": "~^3", "d": 5}, "devDependencies": {"b": "9.9.9", "e": "*"}}
    rows = ds.declared_dependencies(manifest(text, {"name": "none"}, {"devDependencies": {"z": "1"}})).collect()
    found = sorted((r.dependent_version, r.package, r.version) for r in rows)
    assert found == [("0", "a", "1.0.0"), ("0", "b", "9.9.9"), ("0", "c", "^3"), ("0", "e", "*"), ("2", "z", "1")]
